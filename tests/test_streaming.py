"""Row-level operators give the same rows on a file stream as on the table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.scoring import lexicon_score, score_by_source
from tallyframe.functions.text import fold
from tallyframe.operators.filters import FilterSpec, apply_filters
from tallyframe.operators.products import add_product, preset_lookup
from tallyframe.operators.questions import resolve_scope
from tallyframe.operators.schema import standardize, union_tagged, standardize_all
from tallyframe.session import scratch_path
from tallyframe.sources.readers import tag
from tallyframe.streaming.rows import file_stream, write_available
from workload.sets import catalog
from workload.views import raw_sources, view


def operators(spark):
    lookup = preset_lookup(spark)
    return {
        "score": lambda df: df.select("id_enquete", score_by_source(F.col("source")).alias("s"), lexicon_score("commentaire_global").alias("l")),
        "product": lambda df: add_product(df, lookup).select("id_enquete", "pays", "produit_global"),
        "filter": lambda df: apply_filters(df, FilterSpec(values={"pays": ["maroc", "france"]}, date_end="1997-01-01", search="retard|premium")),
        "fold": lambda df: df.select("id_enquete", fold("commentaire_global").alias("f")),
    }


@pytest.mark.parametrize("name", ["score", "product", "filter", "fold"])
def test_stream_equals_batch(spark, sf, name):
    operator = operators(spark)[name]
    path = scratch_path(spark, "stream-in")
    batch = union_tagged(standardize_all(raw_sources(spark, sf)))
    batch.repartition(4).write.parquet(path)
    batch = spark.read.parquet(path)
    out = scratch_path(spark, "stream-out")
    write_available(file_stream(spark, path, batch.schema, max_files=2), operator, out)
    expected = operator(batch)
    assert sorted(map(repr, spark.read.schema(expected.schema).parquet(out).collect())) == sorted(map(repr, expected.collect()))


def test_tagging_and_scope_stream(spark, sf):
    path = scratch_path(spark, "questions")
    view(spark, sf, "questions").withColumn("selected", F.split("selected_text", ",")).write.parquet(path)
    batch = spark.read.parquet(path)
    out = scratch_path(spark, "stream-out")
    operator = lambda df: resolve_scope(tag(df, catalog()[0])).select("question_id", "effective", "mode", "_kind")
    write_available(file_stream(spark, path, batch.schema), operator, out)
    assert sorted(map(repr, spark.read.parquet(out).collect())) == sorted(map(repr, operator(batch).collect()))


def test_standardize_a_stream(spark, sf):
    path = scratch_path(spark, "raw")
    raw = raw_sources(spark, sf)["Canada"]
    raw.write.parquet(path)
    out = scratch_path(spark, "stream-out")
    write_available(file_stream(spark, path, spark.read.parquet(path).schema), lambda df: standardize("Canada", df), out)
    assert spark.read.parquet(out).count() == raw.count()


def test_a_second_run_adds_only_new_files(spark):
    path, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    for part in range(2):
        spark.range(part * 10, part * 10 + 10).write.mode("append").parquet(path)
        write_available(file_stream(spark, path, spark.read.parquet(path).schema), lambda df: df, out, state)
        assert spark.read.parquet(out).count() == (part + 1) * 10


@pytest.mark.parametrize("pattern", ["some.parquet", "som?.parquet"])
def test_a_table_is_picked_as_a_file_or_a_folder(spark, tmp_path, pattern):
    spark.range(30).repartition(3).write.parquet(str(tmp_path / "folders" / "some.parquet"))
    spark.range(7).write.parquet(str(tmp_path / "folders" / "other.parquet"))
    spark.range(30).coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "files").mkdir()
    for name, made in (("some", "made"), ("other", "made")):
        (tmp_path / "files" / f"{name}.parquet").write_bytes(next((tmp_path / made).glob("part-*")).read_bytes())
    for kind in ("folders", "files"):
        out = scratch_path(spark, "stream-out")
        stream = file_stream(spark, str(tmp_path / kind), spark.range(1).schema, name_pattern=pattern)
        write_available(stream, lambda df: df, out)
        assert sorted(r.id for r in spark.read.schema("id bigint").parquet(out).collect()) == list(range(30)), kind
