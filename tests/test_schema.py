from __future__ import annotations

import pytest
from pyspark.sql import functions as F, types as T

from tallyframe import presets
from tallyframe.operators.products import add_product, preset_lookup, product_lookup, product_reference, require_mapped
from tallyframe.operators.schema import align_union, canonical_country, select_final, split_by_kind, standardize, union_aligned
from tallyframe.plans.wrangle import check_row_counts, normalization_audit, normalize


def germany(spark):
    names = list(presets.COLUMN_MAPS["Allemagne"])
    row = {n: "x" for n in names} | {"land": "\t Deutschland ", "produkt_code": "PAK_002", "gesamtzufriedenheit": "4"}
    return spark.createDataFrame([tuple(row[n] for n in names)], ", ".join(f"{n} string" for n in names))


def test_standardize_renames_completes_and_orders(spark):
    made = standardize("Allemagne", germany(spark))
    assert made.columns == list(presets.CANONICAL_COLUMNS)
    row = made.first()
    assert (row.pays, row.code_produit, row.commentaire_global) == ("Deutschland", "PAK_002", None)


def test_unmapped_column_and_unknown_source_are_errors(spark):
    df = germany(spark).withColumn("extra", F.lit(1))
    with pytest.raises(ValueError, match=r"Colonnes non mappees pour Allemagne: \['extra'\]"):
        standardize("Allemagne", df)
    with pytest.raises(ValueError, match="Mapping absent pour Italie"):
        standardize("Italie", df)


def test_a_dropped_column_comes_back_as_null(spark):
    made = standardize("Allemagne", germany(spark).drop("lieferzeit"))
    assert made.first().delai_livraison is None


def test_country_alias(spark):
    df = spark.createDataFrame([("Deutschland",), ("España",), ("deutschland",), ("France",), (None,)], "c string")
    assert [r[0] for r in df.select(canonical_country(F.col("c"))).collect()] == ["Allemagne", "Espagne", "deutschland", "France", None]


def test_normalize_one_source(spark):
    made = normalize("Allemagne", standardize("Allemagne", germany(spark)), preset_lookup(spark))
    assert made.columns == list(presets.FINAL_COLUMNS)
    row = made.first()
    assert (row.pays, row.produit_global, row.satisfaction_normalisee, row.poids_kg) == ("Allemagne", "EXPRESS", 4.0, None)
    with pytest.raises(ValueError, match="Pays non supporte"):
        normalize("Italie", standardize("Allemagne", germany(spark)), preset_lookup(spark))


def test_product_reference_has_fifteen_rows(spark):
    reference = product_reference(spark)
    assert reference.count() == 15
    assert reference.columns == ["pays", "code_produit_source", "produit_global"]


def test_unmapped_codes_are_named_once(spark):
    df = spark.createDataFrame([("France", "NOPE")] * 5 + [("France", "COLIS_PREMIUM")], "pays string, code_produit string")
    found = add_product(df, product_lookup(product_reference(spark)))
    assert found.count() == 6
    with pytest.raises(ValueError, match="NOPE") as error:
        require_mapped(found)
    assert str(error.value).count("NOPE") == 1


def test_mixed_types_become_text_and_numbers_double(spark):
    a = spark.createDataFrame([(1, 2, 1e7)], "x int, n int, d double")
    b = spark.createDataFrame([("a", 2.5, "z")], "x string, n double, d string")
    made = union_aligned([a, b])
    assert dict(made.dtypes) == {"x": "string", "n": "double", "d": "string"}
    assert sorted(map(tuple, made.collect())) == [("1", 2.0, "10000000.0"), ("a", 2.5, "z")]


def test_display_table_hides_lineage(spark):
    a = spark.createDataFrame([("s", "S", "k", 1)], "_source_id string, _source_label string, _kind string, v int")
    b = spark.createDataFrame([("t", "T", "k", "w")], "_source_id string, _source_label string, _kind string, u string")
    made = align_union({"a": a, "b": b})
    assert made.columns == ["_source_label", "_kind", "v", "u"]
    assert split_by_kind({"a": a, "b": b}, {"a": "one", "b": "two"}).keys() == {"one", "two"}


def test_final_projection_casts(spark):
    df = spark.createDataFrame([("i", "2024-01-01", "x")], "id_enquete string, date_enquete string, poids_kg string")
    made = select_final(df)
    assert made.schema["date_enquete"].dataType == T.TimestampType()
    assert made.first().poids_kg is None and made.first().id_unique == "i"


def test_row_count_check(spark):
    final = standardize("Allemagne", germany(spark))
    made = normalize("Allemagne", final, preset_lookup(spark)).withColumn("source", F.lit("Allemagne"))
    audit = normalization_audit(made, 12)
    assert audit.first().asDict() == {"source": "Allemagne", "rows": 1, "columns": 12, "scored": 1, "unmapped": 0}
    check_row_counts({"Allemagne": final}, audit)
    with pytest.raises(ValueError, match="row count changed"):
        check_row_counts({"Allemagne": final.union(final)}, audit)
