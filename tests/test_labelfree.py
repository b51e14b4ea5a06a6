"""Pools and their tables against numpy."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import labelfree as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for unit, n in (("a", 500), ("b", 90)):
        y = rng.integers(0, 3, n)
        x = np.hstack([np.eye(3)[y] * 2 + rng.normal(size=(n, 3)) + [3, 0, 0] for _ in range(2)])
        out += [(unit, i, int(k), v.tolist(), "clash") for i, (k, v) in enumerate(zip(y, x))]
    return out, spark.createDataFrame(out, "u string, i long, level int, x array<double>, other string").repartition(6).persist()


def test_pools_are_draws_without_replacement(rows):
    data, df = rows
    level = {(u, i): k for u, i, k, *_ in data}
    got = L.pools(df, "u", "i", 3).collect()
    by: dict = {}
    for r in got:
        by.setdefault((r["u"], r["setting"], r["draw"]), []).append(r["i"])
    assert {k[1:] for k in by if k[0] == "a"} == {(s, d) for s, d, *_ in L.plan(3)}
    assert not any(k[0] == "b" and k[1] == "skewed" for k in by)  # b has fewer than 70 rows of a level
    for (u, s, d), ids in by.items():
        assert len(ids) == len(set(ids)) == (100 if s == "skewed" else int(s.split("_")[1]))
        if s == "skewed":
            assert sum(level[u, i] == d // L.SKEWED_DRAWS for i in ids) == 70
    assert len({tuple(sorted(v)) for k, v in by.items() if k[:2] == ("a", "even_16")}) == L.DRAWS
    again = L.pools(df.repartition(2), "u", "i", 3).collect()
    assert {(r["u"], r["setting"], r["draw"], r["i"]) for r in again} == {(r["u"], r["setting"], r["draw"], r["i"]) for r in got}


def test_tables_are_those_of_numpy(rows):
    data, df = rows
    pool, judged = df.filter("i % 2 = 0"), df.filter("i % 2 = 1")
    drawn: dict = {}
    for r in L.pools(pool, "u", "i", 3).collect():
        drawn.setdefault((r["u"], r["setting"]), {}).setdefault(r["draw"], []).append(r["x"])
    for u in "ab":
        drawn[u, "all"] = {0: [v for w, i, _, v, _ in data if w == u and i % 2 == 0]}
    x = {u: np.array([v for w, i, _, v, _ in data if w == u and i % 2]) for u in "ab"}
    y = {u: np.array([k for w, i, k, *_ in data if w == u and i % 2]) for u in "ab"}

    def measures(u, z):
        z = np.round((z[:, :3] + z[:, 3:]) / 2, 9)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        return (p.argmax(1) == y[u]).mean(), np.abs(p @ np.arange(3) - y[u]).mean(), (np.abs(p.argmax(1) - y[u]) <= 1).mean()

    got = {(r["u"], r["variant"], r["setting"]): r for r in L.tables(pool, judged, "u", "i", 3, 2).collect()}
    assert set(got) == {(u, "raw", "none") for u in "ab"} | {(u, v, s) for u, s in drawn for v in ("centred", "scaled")}
    for (u, v, s), r in got.items():
        if v == "raw":
            want = measures(u, x[u])
        else:
            each = [(np.array(d).mean(axis=0), np.array(d).std(axis=0) + 1e-6) for d in drawn[u, s].values()]
            want = np.mean([measures(u, (x[u] - m) / (sd if v == "scaled" else 1)) for m, sd in each], axis=0)
            assert r["draws"] == len(each)
        assert (r["accuracy"], r["mae"], r["within_one"]) == pytest.approx(tuple(want))
        assert r["gain"] == pytest.approx(r["accuracy"] - got[u, "raw", "none"]["accuracy"])
    assert got["a", "scaled", "all"]["gain"] > 0.1


def test_no_pool(rows):
    _, df = rows
    assert {r["variant"] for r in L.tables(df.filter("false"), df, "u", "i", 3, 2).collect()} == {"raw"}
    assert L.tables(df, df.filter(F.lit(False)), "u", "i", 3, 2).count() == 0


def test_parts_of_a_unit_add_up(rows, monkeypatch):
    """A unit judged in parts, in some pieces each, has the tables of one part; rows without a level or logits are left out."""
    _, df = rows
    extra = df.sparkSession.createDataFrame([("a", 9001, None, [0.0] * 6, ""), ("a", 9003, 1, None, "")], df.schema)
    pool, judged = df.filter("i % 2 = 0"), df.filter("i % 2 = 1")
    show = lambda d: {(r["u"], r["variant"], r["setting"]): (r["draws"], *(round(r[c], 9) for c in ("accuracy", "mae", "within_one", "gain"))) for r in d.collect()}
    whole = show(L.tables(pool, judged, "u", "i", 3, 2))
    monkeypatch.setattr(L, "PART", 40)
    monkeypatch.setattr(L, "CHUNK", 7)
    assert show(L.tables(pool, judged.unionByName(extra), "u", "i", 3, 2)) == whole
