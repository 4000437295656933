"""Queries on what is kept between reads: moments, sketches, order indexes; and on sources that lack something."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallyframe.operators.metrics import distinct_cube, distinct_error, distinct_estimates
from tallyframe.operators.moments import Fitted, merge_moments, moments
from tallyframe.operators.order_index import OrderIndex
from tallyframe.operators.paging import sort_orders
from tallyframe.operators.profile import missing_report, numeric_values, profile
from tallyframe.operators.schema import contract_report
from tallyframe.plans.dashboard import dashboard
from tallyframe.plans.quality import quality_of_files
from tallyframe.session import materialize
from tallyframe.sources.readers import SourceSet, SourceSpec
from workload.registry import query
from workload.sets import source_set
from workload.views import BRANCHES, raw_sources, table, view

_NUMBERS = ("quantity", "satisfaction", "discount", "tax", "constant")


@query(
    "merged_moments",
    "\nUNION ALL\n".join(
        f"""SELECT source, '{c}' AS "column", count(*) AS rows, count({c}) AS present, round(avg({c}), 6) AS mean,
          round(stddev_pop({c}), 6) AS spread, min({c}) AS low, max({c}) AS high,
          count(*) FILTER ({c} IS NOT NULL AND satisfaction IS NOT NULL) AS pairs,
          CASE WHEN stddev_pop({c}) = 0 THEN NULL ELSE round(corr({c}, satisfaction), 6) END AS pearson_r FROM lines GROUP BY 1"""
        for c in _NUMBERS
        if c != "satisfaction"
    ),
    uses=("lines",),
)
def merged_moments(spark, sf):
    """Moments of three deliveries, stored one by one and merged."""
    lines = view(spark, sf, "lines").select("source", "l_linenumber", *_NUMBERS)
    parts = [materialize(moments(lines.filter(F.col("l_linenumber") % 3 == i).drop("l_linenumber"), ["source"]), "moments") for i in range(3)]
    whole = Fitted(materialize(merge_moments(reduce(DataFrame.unionByName, parts)), "moments"), ("source",))
    r = whole.correlations().select("source", F.col("variable").alias("column"), F.round("pearson_r", 6).alias("pearson_r"), F.col("n_valid").alias("pairs"))
    spread = F.round(F.sqrt(F.col("squares") / F.col("present")), 6).alias("spread")
    described = whole.lines.select("source", "column", "rows", "present", F.round("mean", 6).alias("mean"), spread, "low", "high")
    return described.join(r, ["source", "column"])


_RANKS = (0.01, 0.25, 0.5, 0.75, 0.99)


@query(
    "quantile_estimates",
    "\nUNION ALL\n".join(
        f"""SELECT source, '{c}' AS "column", CAST({p} AS DOUBLE) AS probability, count({c}) AS valid_count, true AS within FROM lines GROUP BY 1"""
        for c in _NUMBERS
        for p in _RANKS
    ),
    uses=("lines",),
)
def quantile_estimates(spark, sf):
    """Quantiles from stored sketches, and whether the exact rank of each lies within the stated error."""
    lines = view(spark, sf, "lines").select("source", *_NUMBERS)
    found = Fitted.of(lines, ["source"]).quantile_estimates(_RANKS)
    asked = F.inline(F.array(*[F.struct(F.lit(p).alias("probability"), F.col(f"q{i}").alias("estimate")) for i, p in enumerate(_RANKS)]))
    estimates = found.select("source", "column", "present", "rank_error", asked)
    values = numeric_values(lines, ["source"])
    # A few estimates per source and column.
    met = values.join(F.broadcast(estimates), ["source", "column"])
    ranked = met.groupBy("source", "column", "probability", "present", "rank_error").agg(
        F.count_if(F.col("value") < F.col("estimate")).alias("below"), F.count_if(F.col("value") <= F.col("estimate")).alias("upto")
    )
    p, error = F.col("probability"), F.col("rank_error")
    inside = (F.col("below") / F.col("present") <= p + error) & (F.col("upto") / F.col("present") >= p - error)
    return ranked.select("source", "column", "probability", F.col("present").alias("valid_count"), inside.alias("within"))


@query(
    "distinct_estimates",
    """SELECT event_type AS label, count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS events,
      true AS within FROM events GROUP BY 1""",
)
def distinct_estimates_query(spark, sf):
    """Distinct users and events by type from sketches stored by type and day, next to the exact counts."""
    events = table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "user_id", "event_id")
    cube = materialize(distinct_cube(events, ["event_type", "day"], ["user_id", "event_id"]), "distinct")
    about = distinct_estimates(cube, ["event_type"], ["user_id", "event_id"])
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_id").alias("events"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.lit(distinct_error()) * F.col(b)
    within = near("user_id", "users") & near("event_id", "events")
    return about.join(exact, "event_type").select(F.col("event_type").alias("label"), "rows", "users", "events", within.alias("within"))


_DEEP = """SELECT id, priority, round(price, 4) AS price FROM (SELECT *, row_number() OVER (ORDER BY price DESC NULLS LAST, id) - 1 AS r,
      count(*) OVER () AS n FROM gaps) WHERE r >= n // 200 * 100 AND r < n // 200 * 100 + 100"""


@query("indexed_page", _DEEP, uses=("gaps",))
def indexed_page(spark, sf):
    """A page in the middle of a stored order: one range read."""
    gaps = view(spark, sf, "gaps")
    index = OrderIndex.build(gaps, sort_orders(gaps, ["id"], "price", descending=True))
    found = index.page(index.total // 200 + 1, 100)
    return found.rows.select("id", "priority", F.round("price", 4).alias("price"))


@query(
    "indexed_page_after",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
    WHERE (l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey) > (25, 1000, 1, 0, 0)
    ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 60""",
)
def indexed_page_after(spark, sf):
    """The page behind a known row, in ranges of a stored order."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, sf, "lineitem").select(*keys, "l_quantity")
    index = OrderIndex.build(lines, sort_orders(lines, keys, "l_quantity"), range_rows=20_000)
    return index.page_after((25.0, 1000, 1, 0, 0), 60)


# --- Sources that lack something ------------------------------------------------------------


@query(
    "schema_offenders",
    """SELECT 'France' AS source, 'remarque' AS "column", count(*) AS rows, count(commentaire_global) AS present FROM raw_maroc
    UNION ALL SELECT 'Italie', NULL, count(*), NULL FROM raw_canada""",
    uses=("raw_maroc", "raw_canada"),
)
def schema_offenders(spark, sf):
    """Breaches of the schema contract: an unmapped column and a country without a map."""
    raw = raw_sources(spark, sf)
    france = raw["Maroc"].select(F.col("id_enquete"), F.col("commentaire_global").alias("remarque"))
    return contract_report({"France": france, "Italie": raw["Canada"], "Espagne": raw["Espagne"]})


_GAP_COLUMNS = ("id", "price", "balance", "rating", "priority", "status")


@query(
    "profile_without_key",
    f"""SELECT count(*) AS rows, 6 AS columns, {" + ".join(f"(count(*) - count({c}))" for c in _GAP_COLUMNS)} AS total_missing,
      'rating' AS target_column, CAST(0 AS BIGINT) AS duplicate_rows FROM gaps""",
    uses=("gaps",),
)
def profile_without_key(spark, sf):
    """One table that has no source key."""
    gaps = view(spark, sf, "gaps").drop("source")
    return profile(gaps).select("rows", "columns", "total_missing", "target_column", "duplicate_rows")


@query(
    "missing_report_empty_source",
    """SELECT 'gaps' AS source, 'price' AS "column", count(*) - count(price) AS missing_count, count(*) AS row_count FROM gaps
    UNION ALL SELECT 'none', 'price', 0, 0""",
    uses=("gaps",),
)
def missing_report_empty_source(spark, sf):
    """An empty source keeps its lines beside one with rows."""
    prices = view(spark, sf, "gaps").select("price")
    found = missing_report({"gaps": prices, "none": prices.filter("price < 0 and price > 0")})
    return found.select("source", "column", "missing_count", "row_count")


@query(
    "inventory_empty_source",
    """SELECT 'orders' AS id, true AS available, CAST(NULL AS VARCHAR) AS error, count(*) AS rows FROM orders
    UNION ALL SELECT 'events', false, 'Le fichier events.parquet est vide.', 0
    UNION ALL SELECT 'absent', false, 'Source indisponible: absent', 0""",
)
def inventory_empty_source(spark, sf):
    """Tables at hand: one with rows, one without, one that was not given."""
    specs = tuple(SourceSpec(n, n, "satisfaction", f"{n}.parquet") for n in ("orders", "events", "absent"))
    frames = {"orders": table(spark, sf, "orders"), "events": table(spark, sf, "events").filter("event_id < 0")}
    return SourceSet.of(specs, frames).inventory(spark).select("id", "available", "error", "rows")


@query(
    "dashboard_claims_only",
    """SELECT 'row_counts' AS series, 'claims_rows' AS label, CAST(count(*) AS DOUBLE) AS value FROM claim
    UNION ALL SELECT 'row_counts', 'satisfaction_rows', 0
    UNION ALL SELECT 'claims_by_country', pays, count(*) FROM claim WHERE pays IS NOT NULL GROUP BY pays
    UNION ALL SELECT 'overview', 'has_claims', 1 UNION ALL SELECT 'overview', 'has_satisfaction', 0""",
    uses=("claim",),
)
def dashboard_claims_only(spark, sf):
    """A dashboard of claims alone: no survey series, all row counts."""
    made = dashboard(source_set(spark, sf), ["reclamations"])
    series = ["claims_by_country", "satisfaction_by_country", "satisfaction_over_time", "score_distribution"]
    lines = [made[n].select(F.lit(n).alias("series"), F.col("label").cast("string"), F.col("value").cast("double")) for n in series]
    lines.append(made["row_counts"].select(F.lit("row_counts").alias("series"), F.col("id").alias("label"), F.col("rows").cast("double").alias("value")))
    flags = [F.struct(F.lit(n).alias("label"), F.col(n).cast("double").alias("value")) for n in ("has_claims", "has_satisfaction")]
    lines.append(made["overview"].select(F.lit("overview").alias("series"), F.inline(F.array(*flags))))
    return reduce(DataFrame.unionByName, lines)


@query(
    "quality_of_unreadable_files",
    "\nUNION ALL\n".join(
        [f"SELECT 'normalized' AS part, '{b.lower()}' AS id, count(*) AS rows FROM norm WHERE source = '{b}'" for b in BRANCHES]
        + ["SELECT 'normalized', 'reclamations', count(*) FROM claim", "SELECT 'status', 'not available', 1"]
    ),
    uses=("norm", "claim"),
)
def quality_of_unreadable_files(spark, sf):
    """Raw files that cannot be read: no raw report has rows, the status says so, the normalized part is whole."""
    made = quality_of_files(spark, {"France": f"{sf}/absent.parquet"}, source_set(spark, sf))
    raw = [made[n].select(F.lit(n).alias("part"), F.lit("").alias("id"), F.lit(1).cast("bigint").alias("rows")) for n in ("structure", "missing", "outliers")]
    status = made["status"].filter("NOT raw_available AND error IS NOT NULL")
    whole = made["normalized"].select(F.lit("normalized").alias("part"), "id", "rows")
    return reduce(DataFrame.union, [whole, status.select(F.lit("status"), F.lit("not available"), F.lit(1).cast("bigint")), *raw])
