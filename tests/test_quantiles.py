"""Quantiles by running counts against numpy."""
import numpy as np
import pytest

from spreadlens.operators import metrics as M


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles_of_groups(spark, n):
    rng = np.random.default_rng(n)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in rng.integers(-5, 40, n) / 4]
    rows += [("a", None), ("c", None), ("b", float("nan"))]
    qs = {"lo": 0.0, "q": 0.3, "mid": 0.5, "p95": 0.95, "hi": 1.0}
    got = {r["g"]: r for r in M.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", qs, ("g",)).collect()}
    assert set(got) == {"a", "b", None}  # no value, no row
    for g, r in got.items():
        own = [v for k, v in rows if k == g and v is not None and v == v]
        assert [r[k] for k in qs] == pytest.approx([np.quantile(own, q) for q in qs.values()])


def test_quantile_of_a_table(spark):
    df = spark.range(1001).selectExpr("id * id as v")
    assert M.quantile(df, "v", 0.95).first()["quantile"] == pytest.approx(np.quantile(np.arange(1001.0) ** 2, 0.95))
    assert [r["quantile"] for r in M.quantile(df.where("v < 0"), "v", 0.5).collect()] == [None]
    d = M.describe(df.where("v < 0"), "v").first()
    assert d["count"] == 0 and d["p50"] is None


def test_quantile_state(spark):
    plan = M.quantiles(spark.range(5000).selectExpr("id % 2 as g", "id as v"), "v", {"m": 0.5}, ("g",))._jdf.queryExecution().toString()
    assert "percentile" not in plan and "SinglePartition" not in plan
