"""Importance resampling towards a target distribution of hashed word runs.

Every run of one to three words falls into the bucket of its CRC-32. Frequent words and pairs are the head:
their CRC states are shipped to the tasks, and the state of a longer run follows from those of its parts,
because appending ``n`` bytes is a linear map of the state. Runs that hold any other word are the tail and
take the CRC of their bytes. Both give the same exact buckets, so the choice of the head changes no result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.spans import byte_set, hash_spans, mix, row_of, runs, texts_of
from tallyframe.session import materialize

#: Separators of words: the ASCII characters that are neither digits nor letters.
SEPARATORS = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = 0x20
#: Words that are looked at together, however long a text is.
SLICE = 1 << 19


@dataclass(frozen=True)
class Settings:
    buckets: int = 10_000
    #: Of the rows with at least ``least_words`` words, ``percent`` of a hundred are drawn.
    percent: int = 5
    least_words: int = 20
    seed: str = "42"
    #: The head holds at most so many words and pairs, words of at most ``head_bytes`` bytes, and only what
    #: takes this share of the words of some chunk of texts. It bounds what is shipped, not what is counted.
    head_words: int = 65_536
    head_pairs: int = 65_536
    head_bytes: int = 40
    head_share: float = 1 / 65_536


@lru_cache(maxsize=4)
def _appended(longest: int) -> np.ndarray:
    """By number of appended bytes, byte place and byte: what that byte of a CRC becomes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    steps = np.empty((longest + 1, 4, 256), dtype=np.uint32)
    for place in range(4):
        steps[0, place] = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
    for n in range(longest):
        steps[n + 1] = table[steps[n] & np.uint32(0xFF)] ^ (steps[n] >> np.uint32(8))
    return steps.reshape(-1)


def append(crc: np.ndarray, tail: np.ndarray, length: np.ndarray, longest: int) -> np.ndarray:
    """The CRC of each first part followed by a second one with CRC ``tail`` and ``length`` bytes."""
    steps, base = _appended(longest), length.astype(np.int64) << 10
    out = tail.copy()
    for place in range(4):
        out ^= steps[base + (place << 8) + ((crc >> np.uint32(8 * place)) & np.uint32(0xFF)).astype(np.int64)]
    return out


@dataclass
class Words:
    """Some consecutive words of a chunk: folded bytes with one space between words, hashes, and rows."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray
    own: int  # the words before this one begin runs here; the others only end them

    def run(self, first: int, words: int) -> bytes:
        return self.buffer[self.starts[first] : self.ends[first + words - 1]].tobytes()

    def begins(self, words: int) -> np.ndarray:
        """The own words that begin a run of so many words in one row."""
        n = max(min(self.own, len(self.starts) - words + 1), 0)
        return np.flatnonzero(self.rows[:n] == self.rows[words - 1 :][:n])


def words_of(column: pa.Array) -> Iterator[tuple[int, int, Iterator[Words]]]:
    """By chunk of texts: its first row, its number of rows, and its words in slices of bounded size."""
    for chunk in texts_of(column):
        starts, ends, offsets = chunk.spans(SEPARATORS)
        rows = row_of(offsets)

        def slices(chunk=chunk, starts=starts, ends=ends, rows=rows) -> Iterator[Words]:
            for first in range(0, len(starts), SLICE):
                last = min(first + SLICE + 2, len(starts))
                a, b = starts[first:last], ends[first:last]
                part = chunk.buffer[a[0] : b[-1]]
                a, b = a - a[0], b - a[0]
                inside = ~SEPARATORS[part]
                gaps = b[:-1]
                kept = inside.copy()
                kept[gaps] = True
                text = np.where(inside, FOLD[part], np.uint8(SPACE))[kept]
                at = np.cumsum(kept)[a] - 1
                yield Words(
                    text, at, at + (b - a), hash_spans(part, a, b, fold=True), rows[first:last], min(SLICE, len(starts) - first)
                )

        yield chunk.first_row, chunk.rows, slices()


@dataclass
class Head:
    """CRC states of frequent words and pairs, found by the hash of a word and the numbers of two words."""

    words: list[bytes]
    pairs: list[tuple[bytes, bytes]]
    longest: int

    @cached_property
    def tables(self) -> tuple[np.ndarray, ...]:
        spans = np.array([0, *np.cumsum([len(w) + 1 for w in self.words])], dtype=np.int64)
        data = np.frombuffer(b" ".join([*self.words, b""]), dtype=np.uint8)
        hashes = hash_spans(data, spans[:-1], spans[1:] - 1) if self.words else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        words = [self.words[i] for i in order]
        number = {w: i for i, w in enumerate(words)}
        pairs = sorted((number[a] * len(words) + number[b], zlib.crc32(a + b" " + b)) for a, b in self.pairs)
        return (
            hashes[order],
            np.array([zlib.crc32(w) for w in words], dtype=np.uint32),
            np.array([zlib.crc32(b" " + w) for w in words], dtype=np.uint32),
            np.array([len(w) + 1 for w in words], dtype=np.int64),
            np.array([p for p, _ in pairs], dtype=np.int64),
            np.array([c for _, c in pairs], dtype=np.uint32),
        )

    def __getstate__(self):  # tasks build the tables themselves
        return {"words": self.words, "pairs": self.pairs, "longest": self.longest}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def crcs(self, words: Words, length: int, held: dict) -> tuple[np.ndarray, np.ndarray]:
        """The own first words of runs of ``length`` words, and the CRC-32 of each run.

        ``held`` carries the head states of runs from one length to the next.
        """
        hashes, alone, after, size, pair_keys, pair_crcs = self.tables
        if length == 1:
            at = np.searchsorted(hashes, words.hashes)
            at[at == len(hashes)] = 0
            known = hashes[at] == words.hashes if len(hashes) else np.zeros(len(at), dtype=bool)
            held |= {"number": at, "known": known, "whole": known}
            held["state"] = alone[at] if len(hashes) else np.zeros(len(at), np.uint32)
        else:
            n = len(words.starts) - length + 1
            number, last = held["number"], held["number"][length - 1 :]
            whole = held["whole"][: max(n, 0)] & held["known"][length - 1 :]
            state = np.zeros(max(n, 0), dtype=np.uint32)
            rest = np.flatnonzero(whole)
            if length == 2 and len(pair_keys):
                keys = number[rest] * len(hashes) + last[rest]
                at = np.searchsorted(pair_keys, keys)
                at[at == len(pair_keys)] = 0
                found = pair_keys[at] == keys
                state[rest[found]] = pair_crcs[at[found]]
                rest = rest[~found]
            if len(rest):
                state[rest] = append(held["state"][rest], after[last[rest]], size[last[rest]], self.longest + 1)
            held |= {"whole": whole, "state": state}
        firsts = words.begins(length)
        out = held["state"][firsts]
        text = memoryview(words.buffer)
        tail = np.flatnonzero(~held["whole"][firsts])
        begin, end = words.starts[firsts[tail]].tolist(), words.ends[firsts[tail] + length - 1].tolist()
        out[tail] = np.fromiter((zlib.crc32(text[a:b]) for a, b in zip(begin, end)), dtype=np.uint32, count=len(tail))
        return firsts, out


def frequent_runs(texts: DataFrame, settings: Settings, text: str = "text") -> DataFrame:
    """(words, run, n): single words and pairs that are frequent in some chunk of texts, with their counts there."""
    longest = settings.head_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, slices in words_of(batch.column(0)):
                for part in slices:
                    lengths, runs_, counts = [], [], []
                    for length in (1, 2):
                        firsts = part.begins(length)
                        sizes = part.ends - part.starts
                        short = sizes[firsts] <= longest
                        keys = part.hashes[firsts]
                        if length == 2:
                            short &= sizes[firsts + 1] <= longest
                            keys = mix(keys) ^ part.hashes[firsts + 1]
                        firsts, keys = firsts[short], keys[short]
                        if not len(keys):
                            continue
                        order, first = runs(keys)
                        at = np.flatnonzero(first)
                        n = np.diff(np.append(at, len(keys)))
                        much = n >= settings.head_share * part.own
                        for word, times in zip(firsts[order[at[much]]].tolist(), n[much].tolist()):
                            lengths.append(length)
                            runs_.append(part.run(word, length))
                            counts.append(times)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lengths, pa.int32()), pa.array(runs_, pa.binary()), pa.array(counts, pa.int64())],
                        names=["words", "run", "n"],
                    )

    found = texts.select(text).mapInArrow(run, "words int, run binary, n long")
    return found.groupBy("words", "run").agg(F.sum("n").alias("n"))


def find_head(texts: DataFrame, settings: Settings, text: str = "text") -> Head:
    """The most frequent words and pairs; at most ``head_words`` and ``head_pairs`` short rows reach the driver.

    Counts are cut where the runs of all higher eighths of a power of two still fit, so no task sends more
    than the driver keeps.
    """
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    found = materialize(frequent_runs(texts, settings, text).withColumn("step", step), "frequent-runs")
    sizes = found.groupBy("words", "step").count().orderBy(F.desc("step")).collect()  # some hundred rows

    def most(length: int, limit: int) -> list[bytes]:
        least, total = 1 << 20, 0
        for row in sizes:
            if row["words"] == length:
                total += row["count"]
                if total > limit:
                    break
                least = row["step"]
        rows = found.where((F.col("words") == length) & (F.col("step") >= least)).select("run").collect()
        return [bytes(r["run"]) for r in rows]

    words = most(1, settings.head_words)
    known = set(words)
    pairs = [tuple(p.split(b" ")) for p in most(2, settings.head_pairs)]
    return Head(words, [p for p in pairs if p[0] in known and p[1] in known], settings.head_bytes)


def bucket_totals(texts: DataFrame, head, settings: Settings, text: str = "text") -> DataFrame:
    """(bucket, n): the runs of all texts by bucket. A task sends one row per bucket and batch at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(settings.buckets, dtype=np.int64)
        for batch in batches:
            for _, _, slices in words_of(batch.column(0)):
                for part in slices:
                    held: dict = {}
                    for length in (1, 2, 3):
                        _, crcs = head.value.crcs(part, length, held)
                        totals += np.bincount(crcs % np.uint32(settings.buckets), minlength=settings.buckets)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(totals[at])], names=["bucket", "n"])

    return texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(spark: SparkSession, corpus: DataFrame, target: DataFrame, settings: Settings) -> np.ndarray:
    """By bucket the floored logarithm, in thousandths, of its share in the target over that in the corpus."""
    size = settings.buckets
    of = spark.range(size).withColumnRenamed("id", "bucket")
    both = of.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    sums = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    one = {c: F.col(c).cast("double") + F.lit(1.0) for c in ("s", "t")}
    every = {c: F.lit(float(sums[c] + size)) for c in ("s", "t")}
    ratio = one["t"] * every["s"] / (one["s"] * every["t"])
    gains = np.zeros(size, dtype=np.int64)
    for row in both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect():
        gains[row["bucket"]] = row["gain"]
    return gains


def weigh(docs: DataFrame, head, gains, settings: Settings, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row: its runs and the sum of their buckets' gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, features, weight = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for first_row, rows, slices in words_of(batch.column(1)):
                here = slice(first_row, first_row + rows)
                for part in slices:
                    held: dict = {}
                    n_words[here] += np.bincount(part.rows[: part.own], minlength=rows)
                    for length in (1, 2, 3):
                        firsts, crcs = head.value.crcs(part, length, held)
                        of = part.rows[firsts]
                        features[here] += np.bincount(of, minlength=rows)
                        gained = np.concatenate(([0], np.cumsum(gains.value[crcs % np.uint32(settings.buckets)])))
                        at = np.searchsorted(of, np.arange(rows + 1))
                        weight[here] += gained[at[1:]] - gained[at[:-1]]
            made = [batch.column(0), *(pa.array(x) for x in (n_words, features, weight))]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long"
    )


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a seeded hash of the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def ranked(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``rows``, a stored table, with the place from 1 of each row in ``order``, by a range sort.

    The place is that in the sorted partition, which is stored with the row, plus the rows of earlier
    partitions; one window sees one row per partition.
    """
    placed = materialize(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked"
    )
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(sizes), part == F.col("_part"))
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(out, F.col("_before") + local + 1).drop("_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score and rank.

    ``target`` holds the texts whose distribution is drawn towards. Words are runs of digits, letters and
    characters beyond ASCII, with A-Z folded; a null or empty text has none, weight 0, and is never drawn. A
    text of any length is read whole, in slices. Of the rows with ``least_words`` words, the highest scores
    are drawn, ties to the smaller doc_id, a null one last; ``rank`` is null for all others. Rows that
    repeat an id are rows of their own and share its noise; a null id has the noise of the word ``null``.
    Equal rows are ranked in any order. Empty tables on either side are allowed. No other column is read.
    """
    spark = docs.sparkSession
    head = spark.sparkContext.broadcast(find_head(docs, settings, text))
    corpus, wanted = (materialize(bucket_totals(x, head, settings, text), "bucket-totals") for x in (docs, target))
    gains = spark.sparkContext.broadcast(bucket_gains(spark, corpus, wanted, settings))
    score = F.col("weight") + noise(F.col("doc_id"), settings.seed)
    eligible = F.col("n_words") >= settings.least_words
    weighed = weigh(docs, head, gains, settings, text)
    weighed = materialize(
        weighed.select("*", score.alias("score"), eligible.alias("_drawable"), F.monotonically_increasing_id().alias("_row")), "weighed"
    )
    n = weighed.where("_drawable").count()
    drawn = settings.percent * n // 100
    order = [F.desc("_drawable"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    placed = ranked(weighed, order, "_place")
    rank = F.when(F.col("_place") <= drawn, F.col("_place")).cast("long")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
