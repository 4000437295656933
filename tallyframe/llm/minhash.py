"""Near-duplicates of texts: banded MinHash, sequential Bayesian verification, exact confirmation.

1. One pass gives each document its set of word shingles, a digest of the set and the band keys of its
   MinHash signature. Documents with equal digests are one class; only its least document goes on.
2. In each bucket of a band, the document that shares most buckets with others is the centre, and all
   others are paired with it: candidates grow with the rows, not with the square of a bucket. Texts of
   documents in such buckets are shuffled once, for their signatures and full sets.
3. Signatures of a pair are compared batch by batch. After each batch, the posterior of the similarity
   bounds it; a pair is pruned when its chance of reaching the threshold is below the miss probability.
   Survivors are verified on their full sets in the same task, and the links give components.
4. Buckets that still hold several components are finished: pairs across components are compared too,
   in blocks, unless their bounds to the centre rule them out by the triangle inequality of the Jaccard
   distance. Only verified links leave a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.links import components
from tallyframe.llm.spans import BLANKS, hash_spans, mix, texts_of
from tallyframe.session import materialize


@dataclass(frozen=True)
class Settings:
    """``shingle`` words a shingle; links have 100 * shared >= percent * union."""

    shingle: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 5
    #: Hashes of a signature; the bands use the first of them, the comparison all.
    hashes: int = 240
    batch: int = 24
    #: Chance of pruning a pair whose similarity reaches the threshold, at each batch.
    miss: float = 1e-6
    seed: int = 20


SHINGLES_AT_ONCE = 1 << 16
#: Documents of a block, where those left in a bucket are compared.
BLOCK = 128
PAIRS_AT_ONCE = 1 << 12


def _shingles(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order, and by row the index of the first.

    A row with fewer words than ``n`` has its whole sequence as one shingle; without words, none.
    """
    sets, counts = [], np.zeros(len(offsets) - 1, dtype=np.int64)
    for row, (a, b) in enumerate(zip(offsets, offsets[1:])):
        if a == b:
            continue
        size = min(n, b - a)
        keys = np.full(b - a - size + 1, np.uint64(size))
        for step in range(size):
            keys = mix(keys + hashes[a + step : b - size + 1 + step])
        keys = np.unique(keys)
        sets.append(keys)
        counts[row] = len(keys)
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    return flat, np.concatenate(([0], np.cumsum(counts)))


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for chunk in texts_of(column):
        starts, ends, offsets = chunk.spans(BLANKS)
        yield _shingles(hash_spans(chunk.buffer, starts, ends, fold=True), offsets, n)


def signatures(flat: np.ndarray, offsets: np.ndarray, settings: Settings) -> np.ndarray:
    """MinHash signatures, a row of uint32 for each set; of an empty set all ones."""
    rng = np.random.default_rng(settings.seed)
    factors = rng.integers(0, 1 << 63, settings.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(0, 1 << 63, settings.hashes, dtype=np.uint64)
    out = np.full((len(offsets) - 1, settings.hashes), 0xFFFFFFFF, dtype=np.uint32)
    row = 0
    while row < len(offsets) - 1:
        end = max(int(np.searchsorted(offsets, offsets[row] + SHINGLES_AT_ONCE, "right")) - 1, row + 1)
        part = flat[offsets[row] : offsets[end]]
        full = np.flatnonzero(np.diff(offsets[row : end + 1]))
        if len(full):
            firsts = offsets[row : end][full] - offsets[row]
            for k in range(settings.hashes):
                high = ((part * factors[k] + terms[k]) >> np.uint64(32)).astype(np.uint32)
                out[row + full, k] = np.minimum.reduceat(high, firsts)
        row = end
    return out


SKETCH = "doc_id long, text_hash long, n_shingles long, digest_1 long, digest_2 long, bands array<long>"


def sketch(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """One row per row of ``docs``: set size, digest of the set, and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for flat, offsets in shingle_sets(batch.column(2), settings.shingle):
                n = len(offsets) - 1
                signed = signatures(flat, offsets, settings)
                keys = np.zeros((n, settings.bands), dtype=np.uint64)
                keys += np.arange(settings.bands, dtype=np.uint64)
                banded = signed[:, : settings.bands * settings.rows].reshape(n, settings.bands, -1).astype(np.uint64)
                for r in range(settings.rows):
                    keys = mix(keys + banded[:, :, r])
                totals = [np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64))) for x in (flat, mix(flat))]
                digests = [(t[offsets[1:]] - t[offsets[:-1]]).view(np.int64) for t in totals]
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * settings.bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(np.diff(offsets)),
                        pa.array(digests[0]), pa.array(digests[1]),
                        pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64).ravel())),
                    ],
                    names=[part.split()[0] for part in SKETCH.split(", ")],
                )
                at += n

    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), F.col(text))
    return read.mapInArrow(run, SKETCH)


def posterior_bounds(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the similarity by (batches compared, hashes matched).

    The prior is uniform, so after m matches of n the similarity is Beta(m + 1, n - m + 1), and its chance
    of being at most t is that of a binomial of n + 1 draws giving more than m. The bounds leave out
    ``miss`` on either side.
    """
    grid = np.linspace(0, 1, 1001)[1:-1]
    steps = range(settings.batch, settings.hashes + 1, settings.batch)
    low = np.zeros((len(steps), settings.hashes + 1))
    high = np.ones((len(steps), settings.hashes + 1))
    for i, n in enumerate(steps):
        k = np.arange(n + 2)
        ways = np.array([math.lgamma(n + 2) - math.lgamma(x + 1) - math.lgamma(n + 2 - x) for x in k])
        draws = np.exp(ways[None] + k * np.log(grid)[:, None] + (n + 1 - k) * np.log1p(-grid)[:, None])
        at_most = np.cumsum(draws, axis=1)  # chance of at most k draws, by t
        for m in range(n + 1):
            beyond = at_most[:, m]  # chance that the similarity is above t
            low[i, m] = grid[beyond >= 1 - settings.miss].max(initial=0.0)
            high[i, m] = grid[beyond >= settings.miss].max(initial=0.0) + 0.001
    return low, high


def compare(left: np.ndarray, right: np.ndarray, settings: Settings, bounds) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the similarity of each pair of signatures; pruned pairs stop at the batch that prunes them."""
    low, high = np.zeros(len(left)), np.ones(len(left))
    matched = np.zeros(len(left), dtype=np.int64)
    alive = np.arange(len(left))
    for i in range(settings.hashes // settings.batch):
        part = slice(i * settings.batch, (i + 1) * settings.batch)
        matched[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        low[alive], high[alive] = bounds[0][i, matched[alive]], bounds[1][i, matched[alive]]
        alive = alive[high[alive] >= settings.percent / 100]
    return low, high


USED = "id long, is_centre boolean, signature binary, held binary"


def used_sets(asked: DataFrame, docs: DataFrame, text: str, settings: Settings) -> DataFrame:
    """Signature and full set (sorted 64-bit hashes) of each asked id; ``asked`` has id and is_centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for flat, offsets in shingle_sets(batch.column(2), settings.shingle):
                n = len(offsets) - 1
                held = [flat[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
                signed = [s.tobytes() for s in signatures(flat, offsets, settings)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(signed, pa.binary()), pa.array(held, pa.binary())],
                    names=[part.split()[0] for part in USED.split(", ")],
                )
                at += n

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).alias("text"))
    # The join sorts by id, so choosing one text of an id needs no shuffle of its own.
    first = Window.partitionBy("id").orderBy(F.xxhash64("text"))
    joined = texts.join(asked.hint("merge"), "id").withColumn("_place", F.row_number().over(first)).where("_place = 1")
    return joined.select("id", "is_centre", "text").mapInArrow(run, USED)


def _held(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in column]


def _signed(column: pa.Array, settings: Settings) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, settings.hashes)


def _overlap(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union."""
    both = np.sort(np.concatenate((x, y)), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared, len(both) - shared


def verified(pairs: DataFrame, used: DataFrame, settings: Settings) -> DataFrame:
    """``pairs`` (id, centre) with bounds of their similarity and whether they link.

    Pruned pairs have the bounds of the posterior; all others are verified on their sets, so both
    bounds are the similarity itself.
    """
    bounds = posterior_bounds(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = compare(_signed(batch.column(2), settings), _signed(batch.column(4), settings), settings, bounds)
            linked = np.zeros(len(low), dtype=bool)
            left, right = _held(batch.column(3)), _held(batch.column(5))
            for i in np.flatnonzero(high >= settings.percent / 100):
                shared, union = _overlap(left[i], right[i])
                low[i] = high[i] = shared / union
                linked[i] = 100 * shared >= settings.percent * union
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(low), pa.array(high), pa.array(linked)],
                names=["id", "centre", "low", "high", "linked"],
            )

    left = used.select("id", F.col("signature").alias("s1"), F.col("held").alias("h1"))
    right = used.where("is_centre").select(F.col("id").alias("centre"), F.col("signature").alias("s2"), F.col("held").alias("h2"))
    joined = pairs.join(left.hint("merge"), "id").join(right.hint("merge"), "centre")
    return joined.select("id", "centre", "s1", "h1", "s2", "h2").mapInArrow(
        run, "id long, centre long, low double, high double, linked boolean"
    )


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and kept.

    ``component_id`` is the least doc_id that links reach, and a row is kept if it is its own. A null or
    blank text has an empty set and links with nothing. Rows of one doc_id are one document: its first
    text by hash stands for it where texts differ, every row gets its component. A null doc_id links
    with nothing: component null, kept. An empty table gives an empty result. Very long texts are
    shingled whole; other columns are not read.

    A pair of the threshold's similarity shares no band with chance (1 - s**rows)**bands, at most 8e-5
    as set, and is pruned with chance ``miss`` a batch; nothing else loses a link. Confirmed links are
    exact up to equal 64-bit hashes of unlike shingles.
    """
    sketched = materialize(sketch(docs, settings, text), "sketch")
    usable = sketched.where("doc_id IS NOT NULL AND n_shingles > 0")
    same = ["digest_1", "digest_2", "n_shingles"]
    classes = materialize(usable.groupBy(*same).agg(F.min("doc_id").alias("id")), "classes")
    # Equal sets are links of their own; a document with rows in several classes joins them.
    members = usable.select("doc_id", *same).join(classes, same)
    members = members.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()

    # One row of bands for each class's least document.
    first = Window.partitionBy("doc_id").orderBy("text_hash")
    chosen = usable.join(classes.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    chosen = chosen.withColumn("_place", F.row_number().over(first)).where("_place = 1")
    banded = chosen.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key"))
    banded = materialize(banded, "bands")
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = materialize(banded.join(shared, "key"), "buckets")
    weight = buckets.groupBy("id").agg(F.sum(F.col("size") - 1).alias("weight"))
    # The centre of a bucket: the heaviest document, the least of equals.
    centre = (
        buckets.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top"))
        .select("key", (-F.col("top.minus")).alias("centre"))
    )
    placed = materialize(buckets.join(centre, "key").select("key", "band", "id", "size", "centre"), "centres")
    asked = placed.groupBy("id").agg(F.max(F.col("id") == F.col("centre")).alias("is_centre"))
    used = materialize(used_sets(asked, docs, text, settings), "used")
    pairs = placed.where("id <> centre").select("id", "centre").distinct()
    bounded = materialize(verified(pairs, used, settings), "bounds")
    stars = bounded.where("linked").select(F.col("id").alias("a"), F.col("centre").alias("b"))
    labels = components(stars.union(members))
    more = materialize(leftover(placed, bounded, labels, used, settings), "leftover")
    if not more.isEmpty():
        # Labels stand for the links found so far.
        labels = components(more.union(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    found = labels.withColumnRenamed("id", "doc_id")
    joined = sketched.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: one document of each component.

    Of several rows with a kept doc_id one stays, the first by hashed text. Rows without a doc_id stay, and so
    do null and empty texts, one for each id. Columns may have any names; texts are read whole; an empty table
    gives an empty result.
    """
    kept = near_duplicates(docs, settings).where("kept").select("doc_id").distinct()
    names = docs.columns
    plain = [f"_c{i}" for i in range(len(names))]
    of, text = plain[names.index("doc_id")], plain[names.index("text")]
    rows = docs.toDF(*plain)
    # Sorted by doc_id already for the join, so the window adds no shuffle.
    first = Window.partitionBy(of).orderBy(F.xxhash64(text))
    joined = rows.join(kept.withColumnRenamed("doc_id", of), of, "left_semi")
    chosen = joined.withColumn("_place", F.row_number().over(first)).where("_place = 1").select(*plain)
    return chosen.union(rows.where(F.col(of).isNull())).toDF(*names)


def leftover(placed: DataFrame, bounded: DataFrame, labels: DataFrame, used: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) inside a bucket between unlike components, neither document its centre.

    Inside a bucket, documents outside the centre's component are compared with all others, in blocks:
    one row of the join holds two blocks of about ``BLOCK`` documents. With distances p and q of two
    documents to the centre, theirs is at least p - q; that leaves out most documents of the centre's
    component before any block is made. A pair of several buckets is compared in the first.
    """
    reach = 1 - settings.percent / 100 + 1e-9
    held = placed.where("size > 2").join(labels.select("id", "component"), "id", "left")
    held = held.withColumn("component", F.coalesce("component", "id"))
    main = held.where("id = centre").select("key", F.col("component").alias("main"))
    rows = held.where("id <> centre").join(main, "key").join(bounded, ["id", "centre"])
    rows = materialize(rows.select("key", "band", "id", "component", (F.col("component") == F.col("main")).alias("inside"), "low", "high"), "leftover-rows")
    outside = rows.where("NOT inside").groupBy("key").agg(F.min("low").alias("out_low"), F.max("high").alias("out_high"))
    rows = rows.join(outside, "key").where(
        (~F.col("inside")) | ((F.col("low") - F.col("out_high") <= reach) & (F.col("out_low") - F.col("high") <= reach))
    ).drop("out_low", "out_high")
    counts = rows.groupBy("key", "inside").agg(F.count("*").alias("n"))
    several = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("int")
    fields = ["id", "component", "low", "high", "signature", "held"]
    blocks = (
        rows.join(several, "key", "left_semi").join(counts, ["key", "inside"])
        .join(used.select("id", "signature", "held"), "id")
        .groupBy("key", "band", "inside", chunk.alias("chunk"))
        .agg(F.collect_list(F.struct(*fields)).alias("rows"))
    )
    blocks = materialize(blocks, "leftover-blocks")
    bounds = posterior_bounds(settings)

    def unpack(rows: pa.ListScalar) -> dict:
        flat = rows.values
        plain = {name: flat.field(name).to_numpy() for name in fields[:4]}
        return plain | {"signature": _signed(flat.field("signature"), settings), "held": _held(flat.field("held"))}

    def first_band(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        on = slice(0, settings.bands * settings.rows)
        return (x[:, on] == y[:, on]).reshape(len(x), settings.bands, -1).all(axis=2).argmax(axis=1)

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        shared, union = _overlap(x, y)
        return 100 * shared >= settings.percent * union

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, left, right in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                x, y = unpack(left), unpack(right)
                open_pair = (x["component"][:, None] != y["component"]) & (x["id"][:, None] != y["id"])
                open_pair &= x["low"][:, None] - y["high"] <= reach
                open_pair &= y["low"] - x["high"][:, None] <= reach
                i, j = np.nonzero(open_pair)
                for at in range(0, len(i), PAIRS_AT_ONCE):
                    p, q = i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE]
                    left_signed, right_signed = x["signature"][p], y["signature"][q]
                    passed = compare(left_signed, right_signed, settings, bounds)[1] >= settings.percent / 100
                    passed &= first_band(left_signed, right_signed) == band
                    near = np.array([k for k in np.flatnonzero(passed) if linked(x["held"][p[k]], y["held"][q[k]])], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x["id"][p[near]]), pa.array(y["id"][q[near]])], names=["a", "b"])

    x, y = blocks.where("NOT inside").alias("x"), blocks.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("y.inside") | (F.col("x.chunk") <= F.col("y.chunk"))))
    return met.select("x.band", F.col("x.rows").alias("left"), F.col("y.rows").alias("right")).mapInArrow(run, "a long, b long").distinct()
