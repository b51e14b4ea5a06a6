from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.llm import topk


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        found = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in ok if j != q and len(a) == len(b))[:k]
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("coord", "warm"), [(0.0, 20), (0.8, 1), (2.0, 100_000)])
def test_same_as_brute_force(spark, monkeypatch, coord, warm):
    monkeypatch.setattr(topk, "WARM", warm)
    monkeypatch.setattr(topk, "COORD_FROM", coord)
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 7)
    monkeypatch.setattr(topk, "WALK", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * rng.choice([0.1, 1, 5], (300, 1))
    x[50:90] = x[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1005, []), (1010, [1.0, None]), (1015, [float("nan")] * 8), (1020, [float("inf")] * 8), (1025, [0.0] * 8), (1030, [1.0, 2.0]), (1031, [2.0, 1.0]), (None, [1.0] * 8), (20, x[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = topk.top_k(df, F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 5)
    assert {r["rank"] for r in got} == {1, 2, 3, 4, 5}


def test_large_integers_and_empty(spark):
    df = spark.createDataFrame([(0, [3e6, 1.0]), (1, [2e6, 5.0]), (2, [1e6, -7.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()]
    assert got == [(0, 1, 1, 768000000 * 512000000 + 256 * 1280), (0, 2, 2, 768000000 * 256000000 - 256 * 1792)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(df, F.col("vec_id") == 9).count() == 0
