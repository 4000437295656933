"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialize

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the least id that links reach.

    Each round, every id takes the least label among its neighbours' labels, then the label of its label.
    Labels only fall and stop at the least id; rounds grow with the logarithm of a chain's length in the
    usual case. Labels are written to shared storage each round, so a lost executor repeats one round.
    Aggregates combine before the shuffle, so an id with very many links is no bottleneck. Links may
    repeat, point either way, or join an id to itself; an empty table gives an empty result.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = materialize(links.union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")), "labels")
    for _ in range(MAX_ROUNDS):
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        lower = materialize(lower, "labels")
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("further"))
        jumped = lower.join(jump, "component", "left").select(
            "id", "old", F.least("component", F.coalesce("further", "component")).alias("component")
        )
        jumped = materialize(jumped, "labels")
        changed = jumped.where("component <> old").limit(1).count()
        labels = jumped.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
