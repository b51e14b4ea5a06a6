"""Contrasts against plain loops over small rows, with nulls, repeats, missing variants and empty tables."""
from __future__ import annotations

import statistics

import numpy as np
import pytest

from calibra.operators import contrasts as C
from calibra.operators import fits, metrics


def by(rows, *keys):
    return {tuple(r[k] for k in keys): r for r in rows}


def test_budget_sweep_compares_items_with_themselves(spark):
    rows, plain = [], {}
    for i in range(60):
        for b in (64, 256):
            if b == 256 and i % 7 == 0:
                continue
            c = int((i * 31 + b) % 5 < (2 if b == 64 else 3))
            rows.append((None if i % 2 else "u", i, b, c, b - i % 3, 100.0 + i + b))
            plain.setdefault((None if i % 2 else "u", i), {})[b] = (c, b - i % 3, 100.0 + i + b)
    rows += [(*rows[0][:3], 0, 1, 1.0), ("u", None, 64, 1, 1, 1.0), ("u", 999, 64, None, 1, 1.0), ("u", 5, 7, 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "unit string, item long, budget int, correct int, tokens int, latency double")
    got = by(C.budget_sweep(df, ["unit"], "item", "budget", [64, 256], "correct", "tokens", "latency").collect(), "unit", "budget")
    for u in (None, "u"):
        both = [v for (k, _), v in plain.items() if k == u and len(v) == 2]
        for b in (64, 256):
            r = got[u, b]
            assert r["n"] == len(both) and r["accuracy"] == pytest.approx(np.mean([v[b][0] for v in both])) and r["p50"] == pytest.approx(statistics.median(v[b][2] for v in both))
            assert r["gained"] == sum(v[b][0] > v[64][0] for v in both) and r["lost"] == sum(v[b][0] < v[64][0] for v in both) and r["tokens"] == pytest.approx(np.mean([v[b][1] for v in both]))
    assert C.budget_sweep(df.limit(0), ["unit"], "item", "budget", [64, 256], "correct", "tokens", "latency").count() == 0


def test_repeated_answers_count_once_and_the_wrong_one(spark):
    df = spark.createDataFrame([(1, "a", True), (1, "a", False), (1, "b", True), (2, "a", True), (2, "b", True), (2, "b", True)], "item long, system string, correct boolean").selectExpr("'u' AS unit", "*")
    got = by(C.route_gaps(df, "unit", "item", "system", "a", ["b"], "correct").collect(), "route")
    assert got["a",]["n"] == 2 and got["a",]["accuracy"] == 0.5 and got["b",]["points"] == 50.0


def test_flips_count_only_clean_no_answers(spark):
    rows = [("s", i, v, z) for i, (a, b) in enumerate([(-1.0, 2.0), (-1.0, -0.5), (1.0, 3.0), (-2.0, None), (0.0, -1.0)]) for v, z in (("clean", a), ("injected", b))] + [("t", 9, "clean", 1.0), ("t", 9, "injected", 1.5)]
    df = spark.createDataFrame(rows, "unit string, pair long, variant string, z double")
    got = by(C.paired_flips(df, ["unit"], "pair", "variant", "z").collect(), "unit")
    s, t = got["s",], got["t",]
    assert (s["pairs"], s["clean_yes"], s["changed_yes"], s["flipped"], s["flip_rate"]) == (4, 2, 2, 1, 0.5)
    assert s["mean_shift"] == pytest.approx(np.mean([3.0, 0.5, 2.0, -1.0])) and s["median_shift"] == 1.25 and s["max_shift"] == 3.0
    assert t["pairs"] == 1 and t["flip_rate"] is None
    assert C.paired_flips(df.limit(0), ["unit"], "pair", "variant", "z").count() == 0


def test_open_set(spark):
    rows = [("u", [0.1, 0.2, 0.7], 2), ("u", [0.6, 0.2, 0.2], 2), ("u", [0.5, 0.3, 0.2], 0), ("u", [0.1, 0.1, 0.8], 1), ("v", [0.9, 0.05, 0.05], 0), ("v", None, 2)]
    from pyspark.sql import functions as F

    got = by(C.open_set(spark.createDataFrame(rows, "unit string, p array<double>, y int"), ["unit"], "p", "y", F.lit(2)).collect(), "unit")
    u, v = got["u",], got["v",]
    assert (u["held"], u["held_other"], u["known"], u["known_accuracy"], u["known_other"]) == (2, 0.5, 2, 0.5, 0.5)
    assert u["p_other_held"] == pytest.approx(0.45) and u["p_other_known"] == pytest.approx(0.5) and v["held"] == 0 and v["held_other"] is None


def test_defective_items_leave_by_the_rule_of_their_source(spark):
    rng = np.random.default_rng(3)
    rows = [("u", i, s, bool(rng.random() < 0.6)) for i in range(80) for s in "ab" if not (s == "b" and i % 9 == 0)]
    df = spark.createDataFrame(rows, "unit string, item long, system string, correct boolean")
    bad = {i for i in range(80) if i % 4 == 1}
    flagged = spark.createDataFrame([(i,) for i in bad for _ in range(2)] + [(None,)], "item long")
    got = by(C.defects(df, flagged, ["unit"], "item", "system", ["a", "b"], "correct").collect(), "scope", "system")
    hits = {(i, s): c for _, i, s, c in rows}
    for scope, out in (("all", set()), ("without", bad)):
        items = [i for i in range(80) if i not in out]
        shared = [i for i in items if (i, "b") in hits]
        assert got[scope, "a"]["n_own"] == len(items) and got[scope, "b"]["n_own"] == got[scope, "a"]["n_shared"] == len(shared)
        assert got[scope, "a"]["accuracy_shared"] == pytest.approx(np.mean([hits[i, "a"] for i in shared]))
        assert got[scope, "a"]["wrong_for_all"] == sum(not hits[i, "a"] and not hits[i, "b"] for i in shared)


def test_verdicts(spark):
    gaps = spark.createDataFrame([("x", "b", 4.0), ("y", "b", -6.0), ("x", "c", 15.0)], "unit string, route string, points double")
    claims = [C.Claim("near", "b", -5, 5), C.Claim("far", "c", 15), C.Claim("one", "b", -5, 5, "x"), C.Claim("nowhere", "d", 0)]
    got = by(C.verdicts(gaps, "unit", claims).collect(), "claim")
    assert [got[c.name,]["supported"] for c in claims] == [False, True, True, False] and got["near",]["least"] == -6.0 and got["nowhere",]["units"] == 0


def test_offsets_are_the_fit_of_the_plain_minimizer(spark):
    rng = np.random.default_rng(5)
    rows, data = [], []
    for i in range(1200):
        y = int(rng.integers(0, 4))
        z = rng.normal(0, 1, 4) + 1.5 * (np.arange(4) == y) + np.array([0, 1.0, -1.0, 0.5])
        rows.append(("u" if i % 3 else None, i, "calibration" if i % 2 else "test", y, z.tolist()))
        data.append((z, y))
    df = spark.createDataFrame(rows, "unit string, item_id long, split string, y int, z array<double>")
    got = by(C.level_offsets(df, "unit", 4, draws=20).collect(), "unit", "fit")
    assert len(got) == 6
    own = [i for i, r in enumerate(rows) if r[0] == "u" and r[2] == "calibration"]
    z, y = np.array([data[i][0] for i in own]), np.array([data[i][1] for i in own])
    want = fits.vector_scaling(z, y)  # log T, then biases
    r = got["u", "level_bias"]
    assert r["temperature"] == pytest.approx(np.exp(want[0]), rel=1e-3) and np.allclose(r["bias"][1:], want[1:], atol=2e-3) and r["bias"][0] == 0.0
    test = [i for i, x in enumerate(rows) if x[0] == "u" and x[2] == "test"]
    logits = (np.array([data[i][0] for i in test]) + r["bias"]) / r["temperature"]
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    yt = np.array([data[i][1] for i in test])
    assert r["n"] == len(test) and r["accuracy"] == pytest.approx(np.mean(p.argmax(1) == yt)) and r["nll"] == pytest.approx(-np.mean(np.log(p[np.arange(len(yt)), yt])))
    assert r["mae"] == pytest.approx(np.mean(np.abs((p * np.arange(4)).sum(1) - yt))) and 0 < r["ece_floor"] < 0.2
    assert got["u", "level_bias"]["nll"] < got["u", "temperature"]["nll"] and got[None, "raw"]["temperature"] == 1.0


def test_offsets_rank_only_rows_at_borders_of_bins(spark, monkeypatch):
    """every row of every fit was ranked, twice."""
    rng, ranked, running = np.random.default_rng(6), [], metrics.running
    rows = []
    for i in range(3000):
        y = int(rng.integers(0, 4))
        z = rng.normal(0, 1, 4) + (np.arange(4) == y)
        rows += [("u", 10 * i + j, "calibration" if j == 0 else "test", y, z.tolist()) for j in range(4)]
    df = spark.createDataFrame(rows, "unit string, item_id long, split string, y int, z array<double>").persist()
    monkeypatch.setattr(metrics, "running", lambda rows, *a, **k: ranked.append(rows.count()) or running(rows, *a, **k))
    got = by(C.level_offsets(df, "unit", 4, draws=30).collect(), "unit", "fit")
    assert len(ranked) == 1 and 0 < ranked[0] < 3 * 9000 / 20
    test = [(r[1], np.array(r[4]), r[3]) for r in rows if r[2] == "test"]
    p = [np.exp(z - z.max()) / np.exp(z - z.max()).sum() for _, z, _ in test]
    conf, right = np.array([x.max() for x in p]), np.array([x.argmax() == y for x, (_, _, y) in zip(p, test)])
    order = np.lexsort(([i for i, _, _ in test], conf))
    want = sum(abs(conf[own].mean() - right[own].mean()) * len(own) for own in np.array_split(order, metrics.BINS)) / len(order)
    assert got["u", "raw"]["ece"] == pytest.approx(want, abs=1e-9)


def test_intervals_hold_the_mean(spark):
    df = spark.createDataFrame([(None if i % 2 else "u", i, "a", i % 4 < 2) for i in range(400)], "unit string, item long, route string, correct boolean")
    got = by(C.route_intervals(df.selectExpr("unit", "item", "route", "int(correct) AS correct"), "unit", "item", "route", "correct", draws=200).collect(), "unit")
    for u in (None, "u"):
        assert got[u,]["low"] < got[u,]["mean"] < got[u,]["high"] and got[u,]["mean"] == pytest.approx(0.5) and got[u,]["clusters"] == 200
