"""The rows that share most words with a question.

Score of a row = number of distinct query words it contains; rows without any are out; ties
go to the earlier row, by an explicit unique order key.

Many questions are answered from postings. A join of rows and questions on words would produce
every pair that shares a common word. Instead:

1. rows of one source with the same asked words score alike, so they are one group, which keeps
   its ``k`` first keys; groups are numbered in key order;
2. a word's first ``k`` groups are scored for every question that holds the word; a question's
   ``k``-th best of them is its threshold: whatever ranks behind it can't be among the best;
3. a group with ``t`` of a question's ``m`` words holds at least ``t - (m - p)`` of any ``p`` of
   them, so lists of the ``p`` rarest words are looked up first, and their count bounds a group's
   score; those of common words are only looked up to score what passes; a group that could do
   no more than tie counts only up to the threshold's own place;
4. only groups whose bound still beats the threshold are scored.

The pairs of questions and groups that share a rare word grow with both, so they are never moved:
the groups are dealt out once, blocks of questions go to where the groups are, and steps 3 and 4
count, bound, score and cut to ``k`` a question there, over arrays of a batch of groups at a time,
not as a line for each shared word. Asked words are numbered, so that groups hold numbers. Nothing
is dropped that could be an answer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyframe.functions.cast import present, ref
from tallyframe.functions.text import query_words, value_text, words
from tallyframe.operators.attach import attach, measure
from tallyframe.operators.ordering import numbered
from tallyframe.session import materialize

DEFAULT_K = 8
# Words that are looked up beyond the fewest that find what beats a threshold, at least one for what ties
# with it: with more of them more lines are counted and fewer groups are scored.
EXTRA_WORDS = 2
# Parts in which the groups found for one question are ranked before the last ranking.
BUCKETS = 64
# Words of questions that are sent to the groups at a time, some 20 MB of them.
BLOCK_WORDS = 500_000
# No asked word is longer than this where all of them are sent to the rows.
WORD_BYTES = 100


def record_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The non-missing cells of a row, printed and joined."""
    cells = []
    for name in columns if columns is not None else df.columns:
        dtype = df.schema[name].dataType
        cells.append(value_text(present(name, dtype), dtype))
    return F.concat_ws(" ", *cells)


def check_question(question: str, k: int) -> None:
    if not question.strip():
        raise ValueError("La question ne peut pas etre vide.")
    if k < 1:
        raise ValueError("top_k doit etre superieur ou egal a 1.")


def retrieve(
    df: DataFrame,
    question: str,
    order_key: str,
    k: int = DEFAULT_K,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The ``k`` best rows for one question with their ``overlap``, best first.

    Narrow except for the final bounded top-k; runs without Python workers.
    """
    check_question(question, k)
    wanted = query_words(F.lit(question))
    overlap = F.size(F.array_intersect(words(record_text(df, columns)), wanted))
    best = df.withColumn("overlap", overlap).orderBy(F.desc("overlap"), ref(order_key)).limit(k)
    # Rows without a shared word sort last; dropping them here keeps one pass over the text.
    return best.filter("overlap > 0")


def question_units(questions: DataFrame, question: str = "question", scope: str | None = None) -> DataFrame:
    """Add the ``words`` of each question and the ``unit`` of questions that rank alike.

    Questions with the same words and the same ordered scope share one unit, so repeated
    questions cost nothing. The unit is a digest, as a question may be a long text. Questions
    without usable words get no unit.
    """
    asked = questions.withColumn("words", F.array_sort(query_words(question)))
    parts = [F.array_join("words", " ")]
    if scope is not None:
        parts.append(F.array_join(scope, ","))
    return asked.withColumn("unit", F.when(F.size("words") > 0, F.sha2(F.concat_ws("|", *parts), 256)))


@dataclass(frozen=True)
class Postings:
    """Rows as groups in key order, and where each word is found.

    ``groups``: source, position, key, keys, words (their numbers). ``sizes``: source, word, its number
    ``code``, how many groups hold it ``n``, and the position ``last`` of its ``k``-th or else last group.
    """

    groups: DataFrame
    sizes: DataFrame
    k: int


def build_postings(narrow: DataFrame, asked: DataFrame, k: int = DEFAULT_K) -> Postings:
    """Postings of ``narrow`` (key, source, words) for the words in ``asked`` (source, word)."""
    coded = _coded(asked)
    placed = numbered(materialize(_alike(narrow, coded, k, "code"), "alike"), "source", "key")
    # One row per source.
    starts = measure(placed.groupBy("source").agg(F.min("position").alias("start")), ["source"])
    groups = attach(placed, starts).withColumn("position", F.col("position") - F.col("start")).drop("start", "group")
    counts = materialize(_word_counts(groups, k), "postings")
    return Postings(groups, coded.join(counts, ["source", "code"]), k)


def _coded(asked: DataFrame) -> DataFrame:
    """(source, word, code): the asked words, numbered."""
    stored = materialize(asked.select("source", "word").distinct(), "asked-words")
    placed = numbered(stored, "source", "word", name="code")
    return materialize(placed.withColumn("code", F.col("code").cast("int")), "codes")


def _word_counts(groups: DataFrame, k: int) -> DataFrame:
    """(source, code, n, last): how many groups hold a word, and the position of the ``k``-th, or else of the last.

    A batch of groups is counted before anything is moved.
    """
    named = groups.select("source", "position", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of_source in _by_source(batch):
                words, owner = _flat(of_source)
                coded = words.dictionary_encode()
                codes, places = coded.indices.to_numpy(), of_source.column(1).to_numpy()[owner]
                order = np.lexsort((places, codes))
                n = np.bincount(codes, minlength=len(coded.dictionary))
                begins = np.cumsum(n) - n
                first = order[np.arange(len(codes)) - np.repeat(begins, n) < k]
                heads = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.minimum(n, k))).astype(np.int32), places[first])
                source = of_source.column(0).take(pa.array(np.zeros(len(n), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([source, coded.dictionary, pa.array(n), heads], names=["source", "code", "n", "heads"])

    schema = T.StructType([named.schema["source"], T.StructField("code", T.IntegerType())])
    schema = schema.add("n", T.LongType()).add("heads", T.ArrayType(T.LongType()))
    counted = named.mapInArrow(run, schema).groupBy("source", "code")
    heads = F.slice(F.sort_array(F.flatten(F.collect_list("heads"))), 1, k)
    return counted.agg(F.sum("n").alias("n"), F.element_at(heads, -1).alias("last"))


def _by_source(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of each source in a batch whose first column is the source; none without a word."""
    batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))
    for source in pc.unique(batch.column(0).drop_null()):
        yield batch.filter(pc.equal(batch.column(0), source))


def _flat(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows, and the row each of them stands in."""
    lists = batch.column(2)
    return lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())


def seeds(asked: DataFrame, units: DataFrame, index: Postings) -> DataFrame:
    """The first groups of every asked word, scored for the questions that hold it.

    ``asked`` holds all words of ``units`` that are found at all.
    """
    words = asked.join(units.select("unit"), "unit", "left_semi").select("unit", "source", "place", "code", "last")
    blocks = _blocks(asked)
    return _union([_seeded(words.filter(_block(blocks) == block), index) for block in range(blocks)])


def _seeded(words: DataFrame, index: Postings) -> DataFrame:
    """Seeds of a block of questions, which is sent to all groups."""
    shipped = words.sparkSession.sparkContext.broadcast(_asked(words.toArrow()))
    groups = index.groups.select("source", "position", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of_source in _by_source(batch):
                asked = shipped.value.get(of_source.column(0)[0].as_py())
                if asked is not None:
                    yield _first_met(of_source, asked)

    types = {f.name: f for f in (*words.schema, *groups.schema)}
    return groups.mapInArrow(run, T.StructType([types[name] for name in _SEED]).add("overlap", T.IntegerType()))


def _first_met(batch: pa.RecordBatch, asked: _Asked) -> pa.RecordBatch:
    """Lines of the groups of one source that are among the first of a question's word, and their overlap."""
    lists, positions, n = _lists(batch, asked), batch.column(1).to_numpy(), batch.num_rows
    common = _common(lists, n)
    first = [held[positions[held] <= last] for held, last in zip(lists, asked.last.tolist())]
    found = _Found()
    numbers, begins = asked.numbers.tolist(), asked.begins.tolist()
    for question, (begin, end) in enumerate(zip(begins[:-1], begins[1:])):
        own = numbers[begin:end]
        near = np.unique(np.concatenate([first[w] for w in own]))
        if len(near):
            found.add(question, near, _overlap(own, near, lists, common, n))
    return found.lines(batch, asked, _SEED)


def thresholds(scored: DataFrame, k: int) -> DataFrame:
    """Per question the overlap, place and position of its ``k``-th best seed.

    A question with fewer seeds has no threshold and needs none: each of its words is in fewer than ``k``
    groups, so all its groups are seeds.
    """
    last = _first(scored, k, "unit").filter(F.col("rank") == k)
    return last.select(
        "unit", F.col("overlap").alias("least"), F.col("place").alias("at_place"), F.col("position").alias("at_position")
    )


def candidates(asked: DataFrame, limits: DataFrame, index: Postings, extra: int = EXTRA_WORDS) -> DataFrame:
    """(unit, source, place, position, ...): the groups that may rank ahead of their question's threshold.

    ``asked`` holds, by question and source, each word's number from rare to common and how many there are.
    """
    known, blocks = _looked_up(asked, limits, extra)
    near = [_anywhere(known.filter(_block(blocks) == block), index).select(*_LINE) for block in range(blocks)]
    return _union(near)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("unit"), F.lit(blocks))


def _looked_up(asked: DataFrame, limits: DataFrame, extra: int) -> tuple[DataFrame, int]:
    """The words with ``rare`` for those that are looked up, and the number of blocks that questions are dealt to.

    A group beats the threshold if more than ``over`` of them are met, or just as many up to the position ``upto``.
    """
    spare = F.col("m") - F.col("least")
    # A group with all words of the threshold can only tie, unless there are more words than that.
    known = asked.join(limits, "unit").filter("m >= least").withColumn("looked", F.least(spare + extra, F.col("m")))
    earlier, same = F.col("place") < F.col("at_place"), F.col("place") == F.col("at_place")
    upto = F.when(earlier, F.lit(2**63 - 1)).when(same, F.col("at_position")).otherwise(F.lit(-1)).cast("bigint")
    # What was not looked up may be there, all of it.
    over = (F.col("least") - F.col("m") + F.col("looked")).cast("int")
    # Where all words would be needed to tie, and no tie counts, there is nothing to find.
    named = known.filter((spare > 0) | (upto >= 0)).select(
        "unit", "source", "place", "code", F.col("least").cast("int").alias("least"), over.alias("over"), upto.alias("upto"),
        (F.col("number") <= F.col("looked")).alias("rare"),
    )
    return materialize(named, "looked"), _blocks(asked)


def _blocks(asked: DataFrame) -> int:
    return max(1, -(-asked.count() // BLOCK_WORDS))


_SEED = ("unit", "source", "place", "position")
_LINE = (*_SEED, "least", "over", "upto")


@dataclass(frozen=True)
class _Asked:
    """A block of questions to one source: its ``codes`` and what is known of each (``last``), and by question a run
    of their places, rare ones first."""

    codes: pa.Array
    last: np.ndarray | None
    numbers: np.ndarray
    begins: np.ndarray
    rare: np.ndarray | None
    lines: dict[str, np.ndarray]


def _asked(block: pa.Table) -> dict[object, _Asked]:
    found = {}
    names = block.column_names
    for source in pc.unique(block["source"]):
        rows = block.filter(pc.equal(block["source"], source))
        order = [("unit", "ascending"), *[("rare", "descending")] * ("rare" in names)]
        rows = rows.sort_by(order).combine_chunks()
        code = rows["code"].combine_chunks().dictionary_encode()
        numbers = code.indices.to_numpy()
        unit = rows["unit"].to_numpy()
        begins = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        rare = np.add.reduceat(rows["rare"].to_numpy().astype(np.int64), begins) if "rare" in names else None
        last = rows["last"].to_numpy()[np.unique(numbers, return_index=True)[1]] if "last" in names else None
        lines = {name: rows[name].to_numpy()[begins] for name in _LINE if name in names and name != "source"}
        found[source.as_py()] = _Asked(code.dictionary, last, numbers, np.append(begins, len(unit)), rare, lines)
    return found


def _lists(batch: pa.RecordBatch, asked: _Asked) -> list[np.ndarray]:
    """For each asked word the rows of the batch that hold it."""
    words, owner = _flat(batch)
    places = pc.fill_null(pc.index_in(words, value_set=asked.codes), -1).to_numpy()
    owner, places = owner[places >= 0], places[places >= 0]
    holders = owner[np.argsort(places, kind="stable")]
    ends = np.cumsum(np.bincount(places, minlength=len(asked.codes)))
    return [holders[i:j] for i, j in zip(np.append(0, ends[:-1]), ends)]


def _overlap(words: list[int], rows: np.ndarray, lists: list[np.ndarray], common: dict[int, np.ndarray], n: int) -> np.ndarray:
    """How many of ``words`` each of ``rows`` holds; lists of common words are not gone through for a few rows."""
    total = np.zeros(len(rows), dtype=np.int64)
    for word in words:
        if word in common:
            total += common[word][rows]
    rest = [lists[word] for word in words if word not in common]
    return total + np.bincount(np.concatenate(rest), minlength=n)[rows] if rest else total


def _common(lists: list[np.ndarray], n: int) -> dict[int, np.ndarray]:
    """For each word that more than one row in 16 holds, whether a row holds it."""
    common = {}
    for word, held in enumerate(lists):
        if 16 * len(held) > n:
            common[word] = np.zeros(n, dtype=bool)
            common[word][held] = True
    return common


class _Found:
    """Rows of a batch found for questions, and their overlap."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, question: int, rows: np.ndarray, overlap: np.ndarray) -> None:
        self.parts.append((np.full(len(rows), question), rows, overlap))

    def lines(self, batch: pa.RecordBatch, asked: _Asked, names: Sequence[str]) -> pa.RecordBatch:
        question, near, overlap = (
            np.concatenate([part[i] for part in self.parts]).astype(np.int64) if self.parts else np.zeros(0, np.int64) for i in range(3)
        )
        made = {name: pa.array(values[question]) for name, values in asked.lines.items()}
        rows = pa.array(near)
        made |= {"source": batch.column(0).take(rows), "position": batch.column(1).take(rows)}
        made |= {"overlap": pa.array(overlap.astype(np.int32))}
        names = [*names, "overlap"]
        return pa.RecordBatch.from_arrays([made[name] for name in names], names=names)


def _anywhere(known: DataFrame, index: Postings, k: int | None = None) -> DataFrame:
    """Groups that pass the bound, wherever they are, found and scored where they are: one block of questions is
    sent to all groups.

    With ``k``, of each batch of groups only those ahead of the threshold, and the ``k`` best a question.
    """
    # A block of questions, of bounded size.
    shipped = known.sparkSession.sparkContext.broadcast(_asked(known.toArrow()))
    dealt = _dealt(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of_source in _by_source(batch):
                asked = shipped.value.get(of_source.column(0)[0].as_py())
                if asked is not None:
                    yield _met(of_source, asked, k)

    types = {f.name: f for f in (*known.schema, *dealt.schema)}
    return dealt.mapInArrow(run, T.StructType([types[name] for name in _LINE]).add("overlap", T.IntegerType()))


def _met(batch: pa.RecordBatch, asked: _Asked, k: int | None) -> pa.RecordBatch:
    """Lines of the groups of one source with the questions whose bound they pass, and their overlap."""
    lists, positions, n = _lists(batch, asked), batch.column(1).to_numpy(), batch.num_rows
    common, lines = _common(lists, n), _Found()
    limits = (asked.begins[:-1], asked.begins[1:], asked.rare, *(asked.lines[x] for x in ("least", "over", "upto")))
    numbers = asked.numbers.tolist()
    for question, (begin, end, rare, least, over, upto) in enumerate(zip(*(x.tolist() for x in limits))):
        met = np.bincount(np.concatenate([lists[w] for w in numbers[begin : begin + rare]]), minlength=n)
        found = np.flatnonzero(met >= over)
        found = found[(met[found] > over) | (positions[found] <= upto)]
        if not len(found):
            continue
        overlap = met[found] + _overlap(numbers[begin + rare : end], found, lists, common, n)
        if k is not None:
            ahead = (overlap > least) | ((overlap == least) & (positions[found] <= upto))
            found, overlap = found[ahead], overlap[ahead]
            best = np.lexsort((positions[found], -overlap))[:k]
            found, overlap = found[best], overlap[best]
        lines.add(question, found, overlap)
    return lines.lines(batch, asked, _LINE)


def _dealt(index: Postings) -> DataFrame:
    return index.groups.select("source", "position", "words").repartition("source", "position")


def _better(asked: DataFrame, limits: DataFrame, index: Postings, k: int, extra: int) -> DataFrame:
    """The ``k`` best groups of each question among those ahead of its threshold, with their overlap."""
    known, blocks = _looked_up(asked, limits, extra)
    found = [_anywhere(known.filter(_block(blocks) == block), index, k) for block in range(blocks)]
    return _first(_union(found), k, "unit").select("unit", "source", "place", "position", "overlap")


def retrieve_many(
    rows: DataFrame,
    questions: DataFrame,
    order_key: str,
    k: int = DEFAULT_K,
    text: Column | None = None,
    source: str | None = None,
    scope: str | None = None,
    buckets: int = BUCKETS,
    extra: int = EXTRA_WORDS,
) -> DataFrame:
    """``unit``, ``rank``, ``overlap``, source and order key of the ``k`` best rows per unit.

    ``questions`` comes from ``question_units``. With ``source`` (a column of the rows) and
    ``scope`` (an array column of the questions) a question sees only the rows of its scope,
    and rows of an earlier source in the scope win ties. The rows are read once, when called.
    ``buckets`` and ``extra`` say how the work is dealt, never the result.
    """
    if k < 1:
        raise ValueError("top_k doit etre superieur ou egal a 1.")
    if extra < 1:
        raise ValueError(f"extra must be at least 1, not {extra}")
    scopes = F.col(scope) if scope is not None else F.array(F.lit(""))
    units = questions.filter("unit is not null").select("unit", "words", scopes.alias("scope"))
    units = units.dropDuplicates(["unit"]).withColumnRenamed("unit", "name")
    # A number in place of the digest, which would stand in every line.
    units = materialize(units.withColumn("unit", F.monotonically_increasing_id()), "units")
    places = units.select("unit", "words", F.posexplode("scope").alias("place", "source"))
    places = places.groupBy("unit", "source").agg(F.min("place").alias("place"), F.first("words").alias("words"))
    wanted = places.select("unit", "source", "place", F.explode("words").alias("word"))

    tokens = words(record_text(rows) if text is None else text)
    origin = ref(source) if source is not None else F.lit("")
    narrow = rows.select(ref(order_key).alias("key"), origin.alias("source"), tokens.alias("words"))
    index = build_postings(narrow, wanted.select("source", "word").distinct(), k)
    asked = materialize(_by_rarity(wanted, index), "asked")
    scored = materialize(seeds(asked, units, index), "seeds")
    more = materialize(_better(asked, thresholds(scored, k), index, k, extra), "better").select(*scored.columns)
    part = F.pmod(F.xxhash64("source", "position"), F.lit(buckets))
    every = scored.union(more).distinct().withColumn("part", part)
    best = _first(_first(every, k, "unit", "part"), k, "unit").drop("rank", "part")
    keyed = best.join(index.groups.select("source", "position", "keys"), ["source", "position"]).drop("position")
    keyed = keyed.join(units.select("unit", "name"), "unit").drop("unit").withColumnRenamed("name", "unit")
    found = keyed.select("unit", "place", "source", "overlap", F.explode("keys").alias("position"))
    top = _first(found, k, "unit")
    return top.select("unit", "rank", "overlap", "source", F.col("position").alias(order_key))


def _by_rarity(wanted: DataFrame, index: Postings) -> DataFrame:
    """The words of each question and source that are found at all, numbered from rare to common."""
    of = Window.partitionBy("unit", "source")
    return wanted.join(index.sizes, ["source", "word"]).select(
        "unit", "source", "place", "word", "code", "last",
        F.row_number().over(of.orderBy("n", "word")).alias("number"), F.count(F.lit(1)).over(of).cast("int").alias("m"),
    )


def _alike(narrow: DataFrame, asked: DataFrame, k: int, name: str = "word") -> DataFrame:
    """Rows grouped by source and asked words: the words, the first key and the first ``k`` keys of each group.

    Words stand as the column ``name`` of ``asked``, which holds each word of a source once.
    """
    # Not ``explode``: the filter that comes with it would compute the words twice.
    single = narrow.select("source", "key", F.explode_outer("words").alias("word"))
    # So long as the asked words can be sent to the rows, no word of a row is moved but the asked ones.
    named = asked.select(*dict.fromkeys(["source", "word", name]))
    held = attach(single, measure(named, ["source", "word"], row_bytes=WORD_BYTES), "inner").groupBy("source", "key")
    sets = held.agg(F.array_sort(F.collect_set(name)).alias("words"))
    sets = sets.withColumn("group", F.sha2(F.array_join(F.col("words").cast("array<string>"), " "), 256))
    number = F.row_number().over(Window.partitionBy("source", "group").orderBy("key"))
    heads = sets.withColumn("number", number).filter(F.col("number") <= k)
    listed = heads.groupBy("source", "group").agg(
        F.first("words").alias("words"), F.sort_array(F.collect_list("key")).alias("keys")
    )
    return listed.withColumn("key", F.get("keys", F.lit(0)))


def _first(scored: DataFrame, k: int, *by: str) -> DataFrame:
    """The ``k`` best lines by overlap, place and position, with their ``rank``; cut before the shuffle too."""
    best = Window.partitionBy(*by).orderBy(F.desc("overlap"), "place", "position")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
