"""Shards that each match the mixture: proportional stratified interleaving.

Inside its source, every row gets a rank in a seeded shuffle and from it a fractional rank. Sorted by
fractional rank, any stretch of rows holds each source in proportion; cutting that order into equal
stretches gives shards whose row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.ranks import bins_for, hash_bin, with_running_sum
from tallyframe.session import materialize


def stratified_shards(
    docs: DataFrame, shards: int = 24, seed: str = "shards", key: str = "doc_id", stratum: str = "source", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot and grown_shard.

    The law is ``rows``: counts of shards are at most one apart, and slots of a shard run from 0
    without a gap. Position p of n goes to shard floor(p * shards / n). A null source is a source of
    its own. A null text counts as empty (size 8, checksum 0). Rows with equal or null ids share
    a place in the shuffle and are told apart by their text's checksum and size; rows equal in all that
    are interchangeable. With fewer rows than shards, some shards are empty; an empty table gives an
    empty result. ``grown_shard`` is null, as this law moves rows when shards are added. Equal texts are
    not kept together: one group may hold a third of all rows, more than a shard.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col(stratum).cast("string").alias("stratum"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("shuffled", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    rows = materialize(rows.withColumn("one", F.lit(1).cast("long")), "shard-rows")
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("stratum_rows"))
    total = rows.count()
    bins = bins_for(total)
    ranked = with_running_sum(
        rows.withColumn("bin", hash_bin(F.col("shuffled"), bins)),
        ["stratum"], "bin", ["shuffled", "doc_id", "text_crc32", "bytes"], "one", "rank",
    )
    fraction = (2 * F.col("rank") + 1) / (2 * F.col("stratum_rows")).cast("double")
    placed = ranked.join(
        sizes.withColumnRenamed("stratum", "_stratum"), F.col("stratum").eqNullSafe(F.col("_stratum"))
    ).select(
        "doc_id", "bytes", "text_crc32", "one", "stratum", "shuffled", "rank", fraction.alias("fraction"),
    )
    placed = placed.withColumn("bin", F.least(F.floor(F.col("fraction") * bins), F.lit(bins - 1)).cast("long"))
    placed = materialize(placed, "shard-ranks")
    ordered = with_running_sum(placed, [], "bin", ["fraction", "stratum", "rank"], "one", "position")
    shard = F.expr(f"position * {shards} div {max(total, 1)}")
    return ordered.select(
        "doc_id",
        (F.col("bytes") + 8).alias("size"),
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("position") - F.expr(f"({shard_expr(shards, total)})")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "stratum",
        "fraction",
        "position",
    )


def shard_expr(shards: int, total: int) -> str:
    """SQL for the first position of a row's shard: the least p with floor(p * shards / n) equal to it."""
    n = max(total, 1)
    return f"((position * {shards} div {n}) * {n} + {shards - 1}) div {shards}"
