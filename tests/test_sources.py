from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.facts import evidence
from tallyframe.operators.filters import FilterSpec, apply_filters
from tallyframe.operators.metrics import group_mean, score_histogram
from tallyframe.plans.dashboard import combined_table, table_page
from tallyframe.plans.wrangle import normalize_all
from tallyframe.operators.products import preset_lookup, product_reference
from tallyframe.operators.schema import standardize_all
from tallyframe.session import scratch_path, shared_dir
from tallyframe.sources.readers import SourceSet, SourceSpec, read_same_schema, read_table, read_tables
from tallyframe.sources.sinks import to_records, write_export, write_normalized, write_standardized
from workload.views import raw_sources


def test_json_array_object_and_lines_are_flattened(spark, tmp_path):
    record = {" id ": 1, "who": {"name": "a", "geo": {"x": 1.5}}, "tags": [1, 2]}
    (tmp_path / "a.json").write_text(json.dumps([record, record]))
    (tmp_path / "o.json").write_text(json.dumps(record, indent=2))
    (tmp_path / "l.jsonl").write_text(json.dumps(record) + "\n" + json.dumps(record))
    for name, n in (("a.json", 2), ("o.json", 1), ("l.jsonl", 2)):
        df = read_table(spark, str(tmp_path / name))
        assert sorted(df.columns) == ["id", "tags", "who.geo.x", "who.name"]
        assert df.count() == n
        assert df.select("`who.geo.x`").first()[0] == 1.5


def test_csv_and_parquet(spark, tmp_path):
    (tmp_path / "t.csv").write_text(" a , b\n1,x\nNaN,y\n")
    df = read_table(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["a", "b"] and df.filter("a is null").count() == 1
    declared = read_table(spark, str(tmp_path / "t.csv"), "a double, b string")
    assert dict(declared.dtypes) == {"a": "double", "b": "string"}
    spark.range(3).withColumnRenamed("id", " id ").write.parquet(str(tmp_path / "p.parquet"))
    assert read_table(spark, str(tmp_path / "p.parquet")).columns == ["id"]


def test_nan_in_columnar_files_is_missing_to_the_operators(spark, tmp_path):
    rows = [("a", 4.0, "x"), ("b", float("nan"), "y"), ("c", None, "z")]
    spark.createDataFrame(rows, "id string, satisfaction_normalisee double, pays string").write.parquet(str(tmp_path / "ok.parquet"))
    sources = SourceSet.load(spark, (SourceSpec("ok", "Ok", "satisfaction", str(tmp_path / "ok.parquet"), order_key="id"),))
    frame = sources.frames["ok"]
    assert [r.id for r in apply_filters(frame, FilterSpec(score_min=1)).collect()] == ["a"]
    assert [tuple(r) for r in group_mean(frame, "pays").collect()] == [("x", 4.0, 1)]
    assert [r.id for r in table_page(sources, ["ok"], sort_by="satisfaction_normalisee", descending=True).rows.collect()] == ["a", "b", "c"]
    assert combined_table(sources, ["ok"]).filter("satisfaction_normalisee is null").count() == 2
    assert "NaN" not in "".join(r.record for r in evidence(sources.frames, {"ok": "id"}).collect())
    assert [r.value for r in score_histogram(frame).collect()] == [1]


def test_unsupported_and_missing(spark, tmp_path):
    with pytest.raises(ValueError, match="Format non supporte"):
        read_table(spark, str(tmp_path / "a.xlsx"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_tables(spark, {"a": str(tmp_path / "a.parquet")})


def test_same_schema_sources_share_a_scan(spark, tmp_path):
    for name, rows in (("france", 3), ("france2", 2)):
        spark.range(rows).write.parquet(str(tmp_path / name))
    df = read_same_schema(spark, {n: str(tmp_path / n) for n in ("france", "france2")})
    assert {r.source: r["count"] for r in df.groupBy("source").count().collect()} == {"france": 3, "france2": 2}


def specs(tmp_path):
    return (
        SourceSpec("ok", "Ok", "satisfaction", str(tmp_path / "ok.parquet"), order_key="id"),
        SourceSpec("empty", "Empty", "satisfaction", str(tmp_path / "empty.parquet")),
        SourceSpec("absent", "Absent", "reclamations", str(tmp_path / "absent.parquet")),
        SourceSpec("broken", "Broken", "satisfaction", str(tmp_path / "broken.parquet")),
    )


def test_inventory_and_status(spark, tmp_path):
    spark.createDataFrame([(1, "3"), (2, "x")], "id int, satisfaction_normalisee string").write.parquet(str(tmp_path / "ok.parquet"))
    spark.createDataFrame([], "id int").write.parquet(str(tmp_path / "empty.parquet"))
    (tmp_path / "broken.parquet").write_text("not parquet")
    sources = SourceSet.load(spark, specs(tmp_path))
    rows = {r.id: r for r in sources.inventory(spark).collect()}
    assert list(rows) == ["ok", "empty", "absent", "broken"] or set(rows) == {"ok", "empty", "absent", "broken"}
    assert rows["ok"].available and rows["ok"].rows == 2
    assert rows["empty"].error == "Le fichier empty.parquet est vide."
    assert rows["absent"].error == "Fichier introuvable: absent.parquet"
    assert rows["broken"].error.startswith("Impossible de lire broken.parquet")
    assert [r.satisfaction_normalisee for r in sources.frames["ok"].orderBy("id").collect()] == [3.0, None]
    assert sources.missing(["ok", "absent"]) == ["Fichier introuvable: absent.parquet"]
    with pytest.raises(ValueError, match="Sources inconnues: nope"):
        sources.pick(["ok", "nope"])
    with pytest.raises(ValueError, match="au moins une"):
        sources.pick([])


@pytest.mark.parametrize("given", [(), ("a",), ("a", "b"), ("b", "c", "a")])
def test_inventory_has_a_line_per_source_without_a_join(spark, given):
    declared = tuple(SourceSpec(n, n.upper(), "satisfaction", f"{n}.parquet") for n in ("a", "b", "c"))
    frames = {n: spark.range(i + 1).withColumn("rows", F.lit("x")) for i, n in enumerate(given)}
    found = SourceSet.of(declared, frames).inventory(spark)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == ["id", "position", "label", "kind", "available", "error", "columns", "n_columns", "rows"]
    for i, (spec, r) in enumerate(zip(declared, found.collect(), strict=True)):
        here = spec.id in given
        assert (r.id, r.position, r.label, r.kind, r.available) == (spec.id, i, spec.label, "satisfaction", here)
        assert r.rows == (given.index(spec.id) + 1 if here else 0) and r.n_columns == len(r.columns.split(", ")) * here
        assert r.error == (None if here else f"Source indisponible: {spec.id}")
    assert SourceSet.of((), {}).inventory(spark).count() == 0


def test_records(spark):
    df = spark.createDataFrame([(2, None), (1, float("nan"))], "id int, v double").withColumn("d", F.lit("2024-01-05 10:00:00").cast("timestamp"))
    found = [json.loads(r.record) for r in to_records(df, 1, "id").collect()]
    assert found == [{"id": 1, "v": None, "d": "2024-01-05T10:00:00.000"}]
    with pytest.raises(ValueError, match="order_key"):
        to_records(df, 1)


def test_standardized_output_and_audit(spark, sf, tmp_path):
    standard = standardize_all(raw_sources(spark, sf))
    audit = {r.country: r for r in write_standardized(standard, str(tmp_path)).collect()}
    assert audit["Maroc"].missing_columns.split(", ")[0] == "delai_livraison" and audit["Maroc"].columns == 15
    table = spark.read.parquet(audit["France"].table_path)
    assert table.count() == audit["France"].rows
    records = spark.read.json(audit["France"].json_path)
    assert records.count() == audit["France"].rows and "commentaire_global" in spark.read.text(audit["France"].json_path).first()[0]


def test_normalized_output_is_partitioned(spark, sf, tmp_path):
    _, consolidated = normalize_all(standardize_all(raw_sources(spark, sf)), preset_lookup(spark))
    paths = write_normalized(consolidated, product_reference(spark), str(tmp_path))
    assert sorted(p.name for p in Path(paths["table"]).glob("source=*")) == [f"source={b}" for b in ("Allemagne", "Canada", "Espagne", "France", "Maroc")]
    assert spark.read.json(paths["reference"]).count() == 15
    plan = spark.read.parquet(paths["table"]).filter("source = 'Maroc'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan


def test_bad_score_commits_nothing(spark, tmp_path):
    df = spark.createDataFrame([("France", 3.0), ("France", None), ("Maroc", 5.5)], "source string, satisfaction_normalisee double")
    with pytest.raises(Exception, match="Scores hors intervalle: 5.5"):
        write_normalized(df, product_reference(spark), str(tmp_path / "out"))
    assert not list((tmp_path / "out").rglob("*.parquet"))
    assert not (tmp_path / "out" / "product_reference").exists()


def test_export_holds_all_rows(spark, tmp_path):
    frames = {"a": spark.range(120).withColumn("_kind", F.lit("k")), "b": spark.range(3).withColumn("x", F.lit(None).cast("string"))}
    out = write_export(frames, str(tmp_path / "e"))
    back = spark.read.csv(out, header=True)
    assert back.count() == 123 and back.columns == ["_kind", "id", "x"]
    assert spark.read.parquet(write_export(frames, str(tmp_path / "p"), "parquet")).count() == 123
    with pytest.raises(ValueError, match="Format"):
        write_export(frames, str(tmp_path / "x"), "xlsx")


def test_scratch_paths_come_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert scratch_path(spark, "x").startswith(shared_dir(spark)) and scratch_path(spark, "x") != scratch_path(spark, "x")
