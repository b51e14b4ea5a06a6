"""Exact quantiles against numpy, on rows that equal buckets do not part well."""
from __future__ import annotations

import numpy as np
import pytest

from calibra.operators import quantiles as Q

SHARES = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("buckets", [2, 7, 4096])
def test_same_as_numpy(spark, monkeypatch, buckets):
    monkeypatch.setattr(Q, "BUCKETS", buckets)
    rng = np.random.default_rng(1)
    groups = {
        "spread": rng.normal(size=2000), "ties": rng.integers(0, 4, 1500).astype(float), "one": np.array([3.5]), "same": np.full(400, -0.0), "two": np.array([1.0, 2.0]), None: rng.exponential(size=333),
        "heavy": np.concatenate([rng.random(300), [1e300, -1e300, 1e12]]), "tiny": rng.random(100) * 5e-324 + rng.random(100) * 1e-310, "whole": np.arange(1000.0),
    }
    rows = [(u, 1, float(v), "clash") for u, vs in groups.items() for v in vs] + [("spread", 1, None, None), ("spread", 1, float("nan"), None), ("none", 1, None, None)]
    got = {r["u"]: r for r in Q.quantiles(spark.createDataFrame(rows, "u string, k int, v double, rank string").repartition(5), ["u", "k"], "v", SHARES).collect()}
    assert set(got) == set(groups)
    for u, v in groups.items():
        assert got[u]["n"] == len(v) and (got[u]["lo"], got[u]["hi"]) == (v.min(), v.max())
        assert np.allclose(got[u]["q"], np.quantile(v, SHARES), rtol=1e-12, atol=0)


def test_no_unit_and_no_rows(spark):
    df = spark.range(11).selectExpr("cast(id as double) as v")
    assert Q.quantiles(df, [], "v", [0.25]).first()["q"] == [2.5]
    assert Q.quantiles(df.filter("v < 0"), [], "v", [0.25]).count() in (0, 1) and not Q.quantiles(df.filter("v < 0").selectExpr("1 as u", "v"), ["u"], "v", [0.5]).count()


def test_many_ranges_are_joined_too(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW_ROWS", 0)
    df = spark.range(3000).selectExpr("id % 50 as u", "cast(id * id % 977 as double) as v")
    got = {r["u"]: r["q"][0] for r in Q.quantiles(df, ["u"], "v", [0.3]).collect()}
    assert all(got[u] == pytest.approx(np.quantile([i * i % 977 for i in range(3000) if i % 50 == u], 0.3)) for u in range(50))
