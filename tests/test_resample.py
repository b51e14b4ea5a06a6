"""Bootstraps run over the clusters themselves, however many."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import resample


def test_all_clusters_count_and_bounds_are_those_of_resampling(spark):
    df = spark.range(60_000).select(F.when(F.col("id") < 50_000, "big").otherwise("small").alias("u"), F.expr("id div 2").alias("c"), (F.xxhash64("id") % 4 == 0).cast("int").alias("ok"))
    got = {r["u"]: r for r in resample.cluster_bootstrap(df, "u", "c", "ok").collect()}
    assert {u: r["clusters"] for u, r in got.items()} == {"big": 25_000, "small": 5_000}
    rng = np.random.default_rng(0)
    for u, r in got.items():
        s = df.filter(F.col("u") == u).groupBy("c").agg(F.sum("ok").alias("s")).toPandas()["s"].to_numpy()
        found = [s[rng.integers(0, len(s), len(s))].mean() / 2 for _ in range(2000)]
        low, high = np.percentile(found, [2.5, 97.5])
        assert r["mean"] == pytest.approx(s.mean() / 2) and r["high"] - r["low"] == pytest.approx(high - low, rel=0.15)
        assert abs(r["low"] - low) < 0.15 * (high - low) and abs(r["high"] - high) < 0.15 * (high - low)


def test_same_as_weighted_sums_at_any_layout(spark, monkeypatch):
    monkeypatch.setattr(resample, "UNITS", 2)
    rows = [(None if i % 5 == 4 else i % 5, i // 3, float(i % 7), float(i % 3) if i % 11 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "u int, c long, a double, b double")
    got = {r["u"]: r for r in resample.cluster_bootstrap(df.repartition(7), "u", "c", "a", "b", draws=50, seed=3).collect()}
    hashed = {r["c"]: r["h"] for r in df.select("c", F.xxhash64("c").alias("h")).distinct().collect()}
    for u in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == u]
        full = [r for r in own if r[3] is not None]
        w = resample.weights(np.array([hashed[r[1]] for r in full]), 50, 3)
        means = np.array([r[2] - r[3] for r in full]) @ w / w.sum(axis=0)
        assert got[u]["clusters"] == len({r[1] for r in own}) and got[u]["mean"] == pytest.approx(np.mean([r[2] - r[3] for r in full]))
        assert [got[u]["low"], got[u]["high"]] == pytest.approx(np.percentile(means, [2.5, 97.5]))


def test_weights_are_poisson():
    w = resample.weights(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 2000), 100, 7)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)


def test_strata_keep_their_share(spark):
    """Two strata of different means and sizes: the interval leaves out the difference between them."""
    rows = [("u", "big", i, float(i % 2)) for i in range(900)] + [("u", "small", 1000 + i, 10.0) for i in range(100)]
    df = spark.createDataFrame(rows, "u string, s string, c long, v double")
    whole = resample.cluster_bootstrap(df, "u", "c", "v").first()
    parts = resample.cluster_bootstrap(df, "u", "c", "v", stratum="s").first()
    assert parts["mean"] == pytest.approx(1.45) == whole["mean"] and parts["clusters"] == 1000
    rng = np.random.default_rng(1)
    found = [0.9 * rng.choice([0.0, 1.0], 900).mean() + 0.1 * 10 for _ in range(2000)]
    low, high = np.percentile(found, [2.5, 97.5])
    assert parts["high"] - parts["low"] == pytest.approx(high - low, rel=0.15)
    assert whole["high"] - whole["low"] > 3 * (parts["high"] - parts["low"])
