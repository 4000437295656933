"""Near-duplicate embeddings by NN-descent.

A neighbour graph starts from a few orders of the vectors along random hyperplanes and is refined by
joins of neighbours' neighbours. Lists that are full of links are saturated: they are enlarged to their
whole component, compared exactly in blocks, so a large group of copies needs no long lists; and what a
full list could not hold, links between saturated vectors of two components, is compared exactly too,
but for blocks whose centres and radii rule a link out. A share
of the vectors, compared with all, audits the recall; below its aim, searches with more orders follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.links import components
from tallyframe.session import materialize


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    #: Neighbours kept per vector while descending.
    k: int = 8
    #: Orders of the first graph, bits of an order's code, and vectors compared at once along it.
    orders: int = 6
    bits: int = 32
    block: int = 256
    #: At most so many joins of neighbours' neighbours; they end early when few lists change.
    rounds: int = 3
    settled: float = 0.02
    #: Vectors of a hub's reverse neighbours that are compared at once; a larger hub has more such parts.
    part: int = 48
    #: One vector in so many is a query of the audit, until that shows ``audit_links`` true links or the next
    #: share is tried; queries compared at once; the recall it asks for, and how many searches may follow.
    shares: tuple[int, ...] = (100, 10, 1)
    audit_links: int = 200
    audit: int = 4096
    recall: float = 0.99
    repeats: int = 3
    seed: int = 7


def unit_rows(column: pa.Array) -> np.ndarray:
    """A matrix of a batch of binary vectors (doubles)."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def units(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, width, unit) of usable vectors, scaled to length one in double precision, as binary.

    Left out are vectors that are null, empty, zero, or hold null or non-finite components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            for value in batch.column(1):
                out.append(None)
                if not value.is_valid or value.values.null_count or not len(value.values):
                    continue
                x = value.values.to_numpy()
                with np.errstate(over="ignore", invalid="ignore"):
                    most = np.abs(x).max()  # scaled first, so that squares neither overflow nor vanish
                    length = np.sqrt(np.square(x / most).sum()) if most else 0.0
                if np.isfinite(most) and length > 0:
                    out[-1] = (x / most / length).tobytes()
            widths = [len(v) // 8 if v else 0 for v in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(widths, pa.int32()), pa.array(out, pa.binary())], names=["id", "width", "unit"])

    read = embeddings.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>"))
    return read.mapInArrow(run, "id long, width int, unit binary").where("unit IS NOT NULL AND id IS NOT NULL")


def _best(ids: np.ndarray, others: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` most similar entries of each id; equal pairs once."""
    order = np.lexsort((others, -sims, ids))
    ids, others, sims = ids[order], others[order], sims[order]
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (others[1:] != others[:-1]) | (sims[1:] != sims[:-1])
    ids, others, sims = ids[fresh], others[fresh], sims[fresh]
    first = np.ones(len(ids), dtype=bool)
    first[1:] = ids[1:] != ids[:-1]
    starts = np.flatnonzero(first)
    rank = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    kept = rank < k
    return ids[kept], others[kept], sims[kept]


def _edges(ids, others, sims) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(others), pa.array(sims)], names=["id", "other", "sim"])


EDGES = "id long, other long, sim double"


def _block_edges(ids: np.ndarray, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sims = matrix @ matrix.T
    np.fill_diagonal(sims, -2.0)
    k = min(k, len(ids) - 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[near].ravel(), np.take_along_axis(sims, near, axis=1).ravel()


def first_graph(vectors: DataFrame, settings: Settings, salt: int) -> DataFrame:
    """Neighbours along random orders: each vector meets those in its block and in half of the next.

    An order sorts by the signs of random projections, then by the first projection, so a group that
    shares all signs is still cut into blocks; blocks never hold more than ``block`` vectors.
    """
    n, half = settings.block, settings.block // 2

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            widths = batch.column(1).to_numpy()
            for width in np.unique(widths):
                rows = batch.filter(pa.array(widths == width))
                matrix = unit_rows(rows.column(2))
                for order in range(settings.orders):
                    planes = np.random.default_rng([settings.seed, salt, order]).standard_normal((width, settings.bits))
                    projected = matrix @ planes
                    code = (projected > 0) @ (1 << np.arange(settings.bits, dtype=np.int64)[::-1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(matrix), order, dtype=np.int32)), rows.column(1), pa.array(code),
                            pa.array(projected[:, 0]), rows.column(0), rows.column(2),
                        ],
                        names=["order", "width", "code", "along", "id", "unit"],
                    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one order and width, less than a block and a half
        group = None
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for key, row_id, unit in zip(keys, batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                if key != group:
                    yield from compare(held)
                    held, group = [], key
                held.append((row_id, unit))
                if len(held) == n:
                    yield from compare(held)
                    held = held[half:]
        yield from compare(held)

    def compare(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            ids = np.array([h[0] for h in held], dtype=np.int64)
            yield _edges(*_block_edges(ids, np.frombuffer(b"".join(h[1] for h in held)).reshape(len(ids), -1), settings.k))

    ordered = vectors.select("id", "width", "unit").mapInArrow(codes, "order int, width int, code long, along double, id long, unit binary")
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["order", "width", "code", "along", "id"]
    return ordered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(meet, EDGES)


def lists(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each vector's edges, combined in the tasks that make them and once more by vector."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > 400_000:
                held = [merged(held)]
                rows = held[0].num_rows
                if rows > 200_000:
                    yield held[0]
                    held, rows = [], 0
        if held:
            yield merged(held)

    def merged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3)]
        return _edges(*_best(*columns, k))

    combined = edges.mapInArrow(best, EDGES)
    grouped = combined.groupBy("id").agg(F.collect_set(F.struct((-F.col("sim")).alias("far"), "other")).alias("near"))
    kept = grouped.select("id", F.explode(F.slice(F.array_sort("near"), 1, k)).alias("n"))
    return kept.select("id", F.col("n.other").alias("other"), (-F.col("n.far")).alias("sim"))


def refine(graph: DataFrame, vectors: DataFrame, settings: Settings) -> DataFrame:
    """Edges among the neighbours of each vector, forward and reverse, and to the vector itself.

    Reverse neighbours of a hub are dealt over as many parts of about ``part`` as it needs; its forward
    neighbours join every part, so none is left out.
    """
    reverse = graph.select(F.col("other").alias("hub"), F.col("id").alias("member"))
    counts = reverse.groupBy("hub").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / settings.part).cast("int"))
    dealt = reverse.join(counts, "hub").select("hub", F.pmod(F.xxhash64("member"), "parts").cast("int").alias("part"), "member")
    forward = graph.select(F.col("id").alias("hub"), F.col("other").alias("member")).join(counts.select("hub", "parts"), "hub", "left")
    forward = forward.select("hub", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "member")
    members = dealt.union(forward).distinct()
    met = (
        members.join(vectors.select(F.col("id").alias("member"), "unit"), "member")
        .groupBy("hub", "part")
        .agg(F.collect_list(F.struct(F.col("member").alias("id"), "unit")).alias("rows"))
        .join(vectors.select(F.col("id").alias("hub"), F.col("unit").alias("hub_unit")), "hub")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for hub, unit, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                flat = rows.values
                ids = np.append(flat.field("id").to_numpy(), hub)
                matrix = np.frombuffer(b"".join([*flat.field("unit").to_pylist(), unit.as_py()])).reshape(len(ids), -1)
                made.append(_block_edges(ids, matrix, settings.k))
            if made:
                yield _edges(*_best(*(np.concatenate(x) for x in zip(*made)), settings.k))

    return met.select("hub", "hub_unit", "rows").mapInArrow(run, EDGES)


def descend(vectors: DataFrame, settings: Settings, salt: int = 0, known: DataFrame | None = None) -> DataFrame:
    """The neighbour graph (id, other, sim), written to shared storage after each round."""
    first = first_graph(vectors, settings, salt)
    graph = materialize(lists(first if known is None else first.union(known), settings.k), "graph")
    for _ in range(settings.rounds):
        better = materialize(lists(refine(graph, vectors, settings).union(graph), settings.k), "graph")
        edges = better.count()
        new = edges - better.join(graph.select("id", "other"), ["id", "other"], "left_semi").count()
        graph = better
        if new <= settings.settled * edges:
            break
    return graph


def linked_in(groups: DataFrame, vectors: DataFrame, settings: Settings) -> DataFrame:
    """(id, n, component) for vectors of ``groups`` (id, component) by exact comparison inside a group.

    A group is cut into blocks by a hash; each row of the join holds two blocks, and what leaves a task is
    a count per vector, never a pair.
    """
    size = settings.block
    counts = groups.groupBy("component").agg(F.count("*").alias("n"))
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / size)).cast("int")
    blocks = materialize(
        groups.join(counts, "component").join(vectors.select("id", "unit", "weight"), "id")
        .groupBy("component", chunk.alias("chunk"))
        .agg(F.collect_list(F.struct("id", "weight", "unit")).alias("rows")),
        "blocks",
    )
    x, y = blocks.alias("x"), blocks.alias("y")
    met = x.join(y, F.col("x.component") == F.col("y.component")).select(F.col("x.rows").alias("left"), F.col("y.rows").alias("right"))

    def unpack(rows):
        flat = rows.values
        return flat.field("id").to_numpy(), flat.field("weight").to_numpy(), unit_rows(flat.field("unit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                ids, _, a = unpack(left)
                others, weights, b = unpack(right)
                near = (a @ b.T >= settings.threshold) & (ids[:, None] != others)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ weights)], names=["id", "n"])

    return met.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def links_across(graph: DataFrame, labels: DataFrame, vectors: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): a link for any two blocks of saturated vectors that lie in two components and have one.

    A list of ``k`` links may have had no room for more. Blocks hold vectors of one component. The angle
    between the centres of two blocks is at most that of a link and both radii if they have a link; all
    centres are compared, in groups, and the vectors of those block pairs that are left.
    """
    size = settings.block
    full = graph.where(F.col("sim") >= settings.threshold).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= settings.k)
    groups = full.select("id").join(labels, "id")
    counts = groups.groupBy("component").agg(F.count("*").alias("n"))
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / size)).cast("int")
    blocks = materialize(
        groups.join(counts, "component").join(vectors.select("id", "width", "unit"), "id")
        .groupBy("component", "width", chunk.alias("chunk"))
        .agg(F.collect_list(F.struct("id", "unit")).alias("rows")),
        "saturated",
    )

    def centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, radii = [], []
            for rows in batch.column(3):
                matrix = unit_rows(rows.values.field("unit"))
                centre = matrix.sum(axis=0)
                length = np.sqrt(centre @ centre)
                centre = centre / length if length > 1e-6 else matrix[0]
                made.append(centre.tobytes())
                radii.append(float(np.arccos(np.clip(matrix @ centre, -1, 1)).max()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(made, pa.binary()), pa.array(radii, pa.float64())],
                names=["component", "width", "chunk", "centre", "radius"],
            )

    found = blocks.select("component", "width", "chunk", "rows").mapInArrow(
        centres, "component long, width int, chunk int, centre binary, radius double"
    )
    found = materialize(found, "centres")
    parts = max(1, -(-found.count() // size))
    # Each group of centres meets each other one under the key (lesser, greater).
    part = F.pmod(F.xxhash64("component", "chunk"), F.lit(parts)).cast("int")
    grouped = found.groupBy("width", part.alias("part")).agg(
        F.collect_list(F.struct("component", "chunk", "centre", "radius")).alias("rows")
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("other")
    keyed = grouped.select("width", "part", "rows", every)
    pair = [F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")]
    low = keyed.where("part <= other").select("width", *pair, F.col("rows").alias("left"))
    high = keyed.where("part >= other").select("width", *pair, F.col("rows").alias("right"))
    met = low.join(high, ["width", "low", "high"]).select("left", "right")
    reach = float(np.arccos(settings.threshold)) + 1e-6

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                x, y = left.values, right.values
                of_x, of_y = x.field("component").to_numpy(), y.field("component").to_numpy()
                angles = np.arccos(np.clip(unit_rows(x.field("centre")) @ unit_rows(y.field("centre")).T, -1, 1))
                angles -= x.field("radius").to_numpy()[:, None] + y.field("radius").to_numpy()
                i, j = np.nonzero((angles <= reach) & (of_x[:, None] != of_y))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of_x[i]), x.field("chunk").take(pa.array(i)), pa.array(of_y[j]), y.field("chunk").take(pa.array(j))],
                    names=["of_a", "chunk_a", "of_b", "chunk_b"],
                )

    pairs = met.mapInArrow(near, "of_a long, chunk_a int, of_b long, chunk_b int")
    block = lambda x: blocks.select(F.col("component").alias(f"of_{x}"), F.col("chunk").alias(f"chunk_{x}"), F.col("rows").alias(f"rows_{x}"))
    both = pairs.join(block("a"), ["of_a", "chunk_a"]).join(block("b"), ["of_b", "chunk_b"]).select("rows_a", "rows_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                x, y = left.values, right.values
                sims = unit_rows(x.field("unit")) @ unit_rows(y.field("unit")).T
                i, j = np.unravel_index(sims.argmax(), sims.shape)
                if sims[i, j] >= settings.threshold:
                    yield pa.RecordBatch.from_arrays([x.field("id").take(pa.array([i])), y.field("id").take(pa.array([j]))], names=["a", "b"])

    return materialize(both.mapInArrow(compare, "a long, b long"), "across")


def audit(vectors: DataFrame, labels: DataFrame, settings: Settings, salt: int = 0) -> tuple[float, DataFrame, bool]:
    """The recall, links (a, b) that cross components, and whether these are all there are.

    The recall is the share of the queries' true links that lie inside a component. Queries are a share of
    the vectors by a hash, compared with all of them; while they have fewer than ``audit_links`` true links,
    the next share is taken. The last share is all vectors: then a component's missed links are all known.
    """
    spark = vectors.sparkSession
    component = F.coalesce("component", "id").alias("component")
    rows = materialize(vectors.select("id", "width", "unit").join(labels, "id", "left").select("id", "width", "unit", component), "audited")
    total = rows.count()
    for share in settings.shares:
        groups = max(1, -(-total // (share * settings.audit)))
        chosen = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(share)) == 0
        group = F.pmod(F.xxhash64("id", F.lit(salt), F.lit("group")), F.lit(groups))
        true, hit, missed = 0, 0, None
        for number in range(groups):
            queries: dict[int, tuple] = {}
            asked = rows.where(chosen & (group == number)).toArrow()
            for width in np.unique(asked["width"].to_numpy()):
                part = asked.filter(pa.array(asked["width"].to_numpy() == width))
                queries[int(width)] = (part["id"].to_numpy(), part["component"].to_numpy(), unit_rows(part["unit"]))
            shipped = spark.sparkContext.broadcast(queries)

            def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    widths = batch.column(1).to_numpy()
                    for width, (ids, of, units_) in shipped.value.items():
                        same = batch.filter(pa.array(widths == width))
                        for first in range(0, same.num_rows, 512):
                            piece = same.slice(first, 512)
                            others, of_others = piece.column(0).to_numpy(), piece.column(3).to_numpy()
                            near = (units_ @ unit_rows(piece.column(2)).T >= settings.threshold) & (ids[:, None] != others)
                            across = near & (of[:, None] != of_others)
                            n, outside = int(near.sum()), int(across.sum())
                            if not n:
                                continue
                            # One link for two components is enough to join them.
                            i, j = np.nonzero(across)
                            _, once = np.unique(np.stack([of[i], of_others[j]], axis=1), axis=0, return_index=True)
                            a, b = np.append(ids[i[once]], 0), np.append(others[j[once]], 0)
                            counts = np.zeros((2, len(a)), dtype=np.int64)
                            counts[:, -1] = n, n - outside
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, *counts)], names=["a", "b", "n", "hit"])

            made = materialize(rows.mapInArrow(run, "a long, b long, n long, hit long"), "audit")
            shipped.unpersist()
            sums = made.agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).first()
            true, hit = true + (sums["n"] or 0), hit + (sums["hit"] or 0)
            links = made.where("n = 0").select("a", "b").distinct()
            missed = links if missed is None else missed.union(links)
        if true >= settings.audit_links:
            break
    return (hit / true if true else 1.0), missed, share == 1


def near_vectors(embeddings: DataFrame, settings: Settings = Settings(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id and kept.

    Links have a cosine of at least ``threshold`` in double precision. Vectors that are null, empty, zero,
    or hold null or non-finite components link with nothing, nor do vectors of unlike length. Equal
    unit vectors are one class while descending and counted by its size; several rows of one id count as
    one vector, by the first of their vectors in byte order. A null id links with nothing: component
    null, kept. An empty table gives an empty result; other columns are not read. If the audited recall is
    below ``recall`` after ``repeats`` searches, it fails with the measured figure.
    """
    usable = units(embeddings, key, vector).groupBy("id").agg(F.min(F.struct("unit", "width")).alias("v"))
    every = materialize(usable.select("id", "v.width", "v.unit"), "units")
    classes = materialize(
        every.groupBy("unit", "width").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "vectors"
    )
    graph, labels = None, None
    for repeat in range(settings.repeats):
        graph = descend(classes, replace(settings, orders=settings.orders << repeat), repeat, graph)
        near = graph.where(F.col("sim") >= settings.threshold)
        near = near.select(F.col("id").alias("a"), F.col("other").alias("b"))
        labels = components(near)
        across = links_across(graph, labels, classes, settings)
        if across.limit(1).count():
            labels = components(near.union(across))
        recall, missed, complete = audit(classes, labels, settings, repeat)
        if complete or recall >= settings.recall:
            if recall < 1:
                labels = components(near.union(across).union(missed))
            break
    else:
        raise RuntimeError(f"recall {recall:.4f} after {settings.repeats} searches is below {settings.recall}")
    counted = linked_in(labels, classes, settings)
    of_class = classes.select("id", "unit", "weight").join(labels, "id", "left").join(counted, "id", "left")
    of_class = of_class.select(
        "unit", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    found = every.join(of_class, "unit").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    joined = embeddings.select(F.col(key).cast("long").alias("vec_id")).join(found, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
