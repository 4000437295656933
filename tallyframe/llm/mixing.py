"""Mixing sources to target weights under a schedule that varies over the training run.

Each source has a linear weight schedule. Its integral over the run is fixed by the source's target, so
the schedule says when its words come, not how many. A source's rows are shuffled and laid end to end,
as often as its target asks for. The word at offset x of that stream is due at the time t at which the
cumulative demand of the schedule reaches x; that inverse is a closed form. Rows sorted by their time
are the curriculum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.ranks import bins_for, hash_bin, with_running_sum
from tallyframe.llm.spans import BLANKS, texts_of
from tallyframe.operators.ordering import numbered
from tallyframe.session import materialize

WEIGHTS = (5, 2, 1)
#: Slopes of the schedules, repeating over the sources: density 1 + slope * (2t - 1) at time t of 0 to 1.
SLOPES = (0.0, 0.5, -0.5)
EPOCHS = 2
BUDGET = 1.5


def count_words(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """The kept columns and ``size``, the number of words of each text; 0 for a null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.diff(chunk.spans(BLANKS)[2]) for chunk in texts_of(batch.column(len(keep)))]
            sizes = np.concatenate(counts) if counts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "size"]
            )

    read = docs.select(*keep, text)
    types = dict(read.dtypes)
    return read.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", size long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, budget: float = BUDGET) -> DataFrame:
    """Per source its size, number, and target.

    Sources in code point order, null last, take the weights in turn. Targets share ``budget`` times all
    sizes by weight; one that would pass ``epochs`` times its source's size stops there, and the rest
    is shared anew by weight. Sorted by size over weight, a source is stopped exactly if, with all before
    it stopped, its share would still pass its limit; so running sums decide it in one step. One window
    sees one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("number", F.row_number().over(by_name) - 1).withColumn("weight", weight.cast("long"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sources = (
        sources.withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("left_words", budget * F.col("all_words") - epochs * F.coalesce(F.sum("source_size").over(earlier), zero))
        .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(earlier), zero))
    )
    share = F.col("weight") * F.col("left_words") / F.col("left_weight")
    sources = sources.withColumn("stopped", share >= epochs * F.col("source_size"))
    # The first source that isn't stopped sets the rate of all that follow it.
    order = F.struct((F.col("source_size") / F.col("weight")).alias("ratio"), "number")
    rate = F.min_by(F.struct("left_words", "left_weight"), F.when(~F.col("stopped"), order)).over(everything)
    sources = sources.withColumn("rate", rate)
    target = F.when(F.col("stopped"), (epochs * F.col("source_size")).cast("double")).otherwise(
        F.col("weight") * F.col("rate.left_words") / F.col("rate.left_weight")
    )
    return sources.select("source", "number", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def due_time(share: Column, slope: Column) -> Column:
    """The time at which the share of a source's demand is reached: the root of t + slope * (t*t - t) = share."""
    rest = 1 - slope
    root = F.sqrt(rest * rest + 4 * slope * share)
    return F.when(share <= 0, 0.0).otherwise(2 * share / (rest + root))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    slopes: Sequence[float] = SLOPES,
    epochs: int = EPOCHS,
    budget: float = BUDGET,
    seed: str = "mix",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The kept columns with size, source, source_size, target, taken, and by epoch words and due times.

    ``parts`` holds, for each epoch, the words taken and the time at which the row's first word of that
    epoch is due, and is null where none is taken. The stream of a source ends at its target, inside a
    row if need be, so taken words differ from a target by less than one word a source. A null text has
    size 0 and is never taken; a null source is a source of its own, last in order. Rows with equal or
    null ids are shuffled alike and told apart by size; rows equal in both are interchangeable. A source
    without words has target 0. An empty table gives an empty result.
    """
    base = docs.select(*keep, *[c for c in ("doc_id", "source") if c not in keep], "text")
    sized = count_words(base, base.columns[:-1])
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = materialize(sized.withColumn("shuffled", shuffled), "mix-sizes")
    bins = bins_for(sized.count())
    laid = with_running_sum(
        sized.withColumn("bin", hash_bin(F.col("shuffled"), bins)),
        ["source"], "bin", ["shuffled", "doc_id", "size"], "size", "start",
    )
    targets = source_targets(sized, weights, epochs, budget).withColumnRenamed("source", "_source")
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), (F.col("number") % len(slopes) + 1).cast("int"))
    laid = laid.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn("slope", slope)
    end = F.round("target").cast("long")
    parts = []
    for epoch in range(epochs):
        at = F.col("start") + epoch * F.col("source_size")
        words = F.greatest(F.least(F.col("size"), end - at), F.lit(0).cast("long"))
        share = F.least(at / F.col("target"), F.lit(1.0))
        parts.append(F.when(words > 0, F.struct(words.alias("words"), due_time(share, F.col("slope")).alias("due"))))
    laid = laid.withColumn("parts", F.array(*parts))
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.coalesce(p["words"], F.lit(0).cast("long")))
    return laid.withColumn("taken", taken).select(
        *keep, *[c for c in ("source",) if c not in keep], "size", "source_size", "target", "taken", "parts"
    )


def curriculum(mixed: DataFrame) -> DataFrame:
    """One row per row and epoch that the mix takes, sorted by due time: ``epoch``, ``words``, ``due``."""
    others = [c for c in mixed.columns if c != "parts"]
    taken = mixed.select(*others, F.posexplode("parts").alias("epoch", "part")).where("part IS NOT NULL")
    rows = taken.select(*others, "epoch", F.col("part.words").alias("words"), F.col("part.due").alias("due"))
    return rows.orderBy("due", *[c for c in ("doc_id",) if c in others], "epoch")


def training_positions(mixed: DataFrame) -> DataFrame:
    """``mixed`` with ``positions``: for each epoch the place from 0 of the row in the curriculum.

    All rows and epochs that are taken are sorted by due time, then id and epoch, in ranges; ``positions`` is
    null for an epoch that takes nothing of the row. Rows equal in time, id and epoch are in any order.
    """
    rows = materialize(mixed.withColumn("_row", F.monotonically_increasing_id()), "mixed")
    taken = rows.select("_row", "doc_id", F.posexplode("parts").alias("_epoch", "_part")).where("_part IS NOT NULL")
    due = materialize(taken.select("_row", "doc_id", "_epoch", F.col("_part.due").alias("_due")), "due")
    placed = numbered(due, F.asc("_due"), F.asc_nulls_first("doc_id"), F.asc("_epoch"), F.asc("_row"), name="_place")
    listed = placed.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_epoch", "_place"))).alias("_places"))
    at = F.transform("parts", lambda p, i: F.when(p.isNotNull(), F.try_element_at("_places", i)))
    return rows.join(listed, "_row", "left").withColumn("positions", at).drop("_row", "_places")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` as the mix trains on them: repeated or left out, in the order of the curriculum.

    A row stands once for each epoch that takes at least half of its words. Rows are matched with their
    places in the mix by id, bytes of text, and number among rows equal in both; a null text has no words
    and is never taken, a null id is an id of its own. All columns come back, whatever their names; texts of any
    length stay whole; an empty table gives an empty result.
    """
    names = docs.columns
    plain = [f"_c{i}" for i in range(len(names))]
    own = {name: F.col(plain[names.index(name)]) for name in ("doc_id", "text", "source")}
    # Plain keys without nulls, so that one shuffle of the texts serves both the window and the join.
    keys = {"_known": own["doc_id"].isNotNull(), "_id": F.coalesce(own["doc_id"], F.lit(0)), "_bytes": F.coalesce(F.octet_length(own["text"]), F.lit(-1))}
    keyed = docs.toDF(*plain).withColumns(keys)
    twins = Window.partitionBy(*keys).orderBy(*keys)
    asked = keyed.select(*keys, *[c.alias(name) for name, c in own.items()])
    parts = mix(asked, keep=("doc_id", *keys), **settings).withColumn("_t", F.row_number().over(twins))
    halves = F.filter("parts", lambda p: p.isNotNull() & (2 * p["words"] >= F.col("size")))
    taken = parts.select(*[F.col(k).alias(f"_of{k}") for k in keys], "_t", halves.alias("_taken")).where(F.size("_taken") > 0)
    rows = keyed.withColumn("_twin", F.row_number().over(twins))
    same = (F.col("_twin") >= F.col("_t")) & (F.col("_twin") <= F.col("_t"))
    for k in keys:
        same &= F.col(k) == F.col(f"_of{k}")
    placed = rows.join(taken.hint("merge"), same).select(*plain, F.explode("_taken.due").alias("_due"))
    return placed.orderBy("_due", own["doc_id"]).select(*plain).toDF(*names)
