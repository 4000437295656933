"""Exact quantiles, both ways of finding them, against NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import tallyframe.operators.quantiles as quantile_module
from tallyframe.operators.quantiles import long_values, quantiles

PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)


def groups():
    rng = np.random.default_rng(5)
    return {
        "even": np.arange(4001, dtype=float),
        "hot": np.concatenate([np.full(3000, 7.0), rng.normal(size=900)]),
        "same": np.full(2500, 1.5),
        "tail": np.exp(rng.normal(size=3000) * 12),
        "two": np.array([1.0, 2.0]),
        "one": np.array([-4.0]),
        "signs": rng.integers(-5, 6, 2000).astype(float),
    }


@pytest.mark.parametrize("direct, cut_values", [(10**6, 2_000_000), (500, 2_000_000), (40, 2_000_000), (100, 150)])
def test_quantiles_equal_numpy(spark, monkeypatch, direct, cut_values):
    monkeypatch.setattr(quantile_module, "CUT_VALUES", cut_values)
    data = groups()
    rows = [(g, float(v)) for g, vs in data.items() for v in vs]
    values = spark.createDataFrame(rows, "g string, value double").repartition(6)
    found = {r[0]: r for r in quantiles(values, ["g"], PROBS, direct_values=direct).collect()}
    assert set(found) == set(data)
    for group, vs in data.items():
        assert found[group]["valid_count"] == len(vs)
        for i, p in enumerate(PROBS):
            assert found[group][f"q{i}"] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12), (group, p)


def test_linear_interpolation(spark):
    values = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "value double").withColumn("g", F.lit("a"))
    row = quantiles(values, ["g"], (0.25, 0.5)).first()
    assert (row.q0, row.q1) == (1.75, 2.5)


def test_long_values_drop_missing(spark):
    df = spark.createDataFrame([("s", 1.0, None), ("s", float("nan"), 4)], "source string, a double, b int")
    rows = sorted(tuple(r) for r in long_values(df, ["source"], ["a", "b"]).collect())
    assert rows == [("s", "a", 1.0), ("s", "b", 4.0)]
