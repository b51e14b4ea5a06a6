"""The steered counter, the assignment and the monotone fit against sequential loops."""
from __future__ import annotations

import random

import numpy as np
import pytest

from calibra.operators import assign, balance, isotonic
from calibra.operators import suites
from pyspark.sql import functions as F


def sequential(rows):
    out, v = {}, 0
    for key, tie, below, zero, above in sorted(rows):
        out[key, tie] = v
        v += above if v > 0 else below if v < 0 else zero
    return out


@pytest.mark.parametrize("kind", ["balanced", "drifting", "returning", "wild"])
@pytest.mark.parametrize("near", [0, 3, 64])
def test_counter_is_that_of_a_loop(spark, monkeypatch, kind, near):
    monkeypatch.setattr(balance, "NEAR", near)
    r = random.Random(kind)
    n, rows = 600, []
    for i in range(n):
        step = {
            "balanced": (2, r.choice([-2, 0, 2]), -2), "drifting": (2, 2, 2),  # the counter grows and keeps its sign
            "returning": (r.choice([0, 2]), 2, 2 if i < 300 else -2), "wild": (r.randrange(-9, 10), r.randrange(-9, 10), r.randrange(-9, 10)),
        }[kind]
        rows.append((float(i // 2), f"t{i:04d}", *step))
    df = spark.createDataFrame(r.sample(rows, n), "k double, tie string, below int, zero int, above int").repartition(5)
    want = sequential(rows)
    for ranges in (1, 9):
        got = balance.counter(df, "k", "tie", ranges).collect()
        assert len(got) == n and {(x["k"], x["tie"]): x["counter"] for x in got} == want


def test_counter_of_no_rows(spark):
    assert balance.counter(spark.createDataFrame([], "k double, tie string, below int, zero int, above int"), "k", "tie").count() == 0


def test_screens_are_balanced_as_by_a_loop(spark):
    r = random.Random(2)
    screens = [(i, {"signed_in": r.random() < 0.9, "error_shown": r.random() < 0.3, "checkbox_checked": r.random() < 0.5}, r.choice([None, "Terms"])) for i in range(120)]
    df = spark.createDataFrame(screens, "screen_id long, states map<string,boolean>, checkbox_label string").repartition(3)
    digest = {(x["i"], x["k"]): x["h"] for x in df.select(F.col("screen_id").alias("i"), F.explode("states").alias("k", "v")).withColumn("h", suites.seeded(F.concat_ws("__", F.col("i").cast("string"), "k"))).collect()}
    want, d = set(), 0
    for i, states, label in screens:
        keys = sorted((k for k in states if k != "checkbox_checked" or label), key=lambda k: digest[i, k])
        picks = sorted(keys, key=lambda k: d if states[k] else -d)[:2]
        want |= {(f"{i}__{k}", str(states[k]).lower()) for k in picks}
        d += sum(1 if states[k] else -1 for k in picks)
    assert {(x["item_id"], x["label"]) for x in suites.ui_state(df).collect()} == want


def plain_assign(rows, levels, needed):
    out, short = [], []
    for u in {x[0] for x in rows}:
        able = {k: sorted({(o, s) for a, s, lv, o in rows if a == u and lv == k and s is not None}) for k in range(levels)}
        used = set()
        for k in sorted(range(levels), key=lambda k: (len(able[k]), k)):
            picks = [s for _, s in able[k] if s not in used][:needed]
            used |= set(picks)
            out += [(u, k, s, i) for i, s in enumerate(picks)]
            if len(picks) < needed:
                short.append((u, k, needed, len(picks)))
    return out, short


def test_assignment_is_the_sequential_one(spark):
    r = random.Random(6)
    rows = [(u, s, k, (s * 37) % 101) for u, n in (("a", 60), ("b", 25), (None, 40)) for s in range(n) for k in range(4) if r.random() < (0.9, 0.5, 0.2, 0.05)[k]]
    rows += rows[:20] + [("a", None, 0, 1), ("a", 1, 9, 1), ("a", 1, None, 1)]
    df = spark.createDataFrame(rows, "u string, s long, level int, o int").repartition(6)
    taken, short = assign.assign(df, "u", "s", F.col("o"), 4, 7)
    want, missing = plain_assign([x for x in rows if x[2] in range(4)], 4, 7)
    key = lambda x: str(x)
    assert sorted(map(tuple, taken.collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, short.collect()), key=key) == sorted(missing, key=key) and missing
    with pytest.raises(ValueError) as e:
        assign.demand(short)
    assert all(f"{u} level {k}: {g} of 7" in str(e.value) for u, k, _, g in missing)
    assign.demand(short.filter("false"))
    assert not assign.assign(df.filter("false"), "u", "s", F.col("o"), 4, 7)[0].count()


def plain_isotonic(x, y):
    """Min-max formula on the distinct x."""
    xs = np.unique(x)
    s, n = (np.array([v[x == a].sum() for a in xs]) for v in (y, np.ones(len(y))))
    mean = lambda a, b: s[a : b + 1].sum() / n[a : b + 1].sum()
    return xs, np.array([max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))])


def test_isotonic_of_groups(spark):
    rng = np.random.default_rng(8)
    groups = {}
    for u, n in (("noisy", 300), ("ties", 200), ("falling", 120), ("rising", 90), ("small", 20), (None, 150)):
        x = {"ties": rng.integers(0, 6, n).astype(float), "falling": np.arange(n) * 1.0, "rising": np.arange(n) * 1.0}.get(u, rng.normal(size=n))
        y = {"falling": -x, "rising": x**2}.get(u, (rng.random(n) < 1 / (1 + np.exp(-2 * x))).astype(float))
        groups[u] = (x, y)
    rows = [(u, float(a), float(b)) for u, (x, y) in groups.items() for a, b in zip(x, y)] + [("noisy", None, 1.0), ("noisy", 1.0, None), ("noisy", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "u string, x double, y double").repartition(5)
    got = {r["u"]: r for r in isotonic.fit(df, "u", "x", "y", 50).collect()}
    assert set(got) == set(groups) - {"small"}
    for u, r in got.items():
        xs, want = plain_isotonic(*groups[u])
        assert r["n"] == len(groups[u][0]) and np.allclose(np.interp(xs, r["xs"], r["ys"]), want)
        assert (np.diff(r["ys"]) >= 0).all() and (np.diff(r["xs"]) > 0).all()


def test_isotonic_needs_its_rows(spark):
    df = spark.range(999).selectExpr("'u' as u", "cast(id as double) as x", "cast(id as double) as y")
    assert isotonic.fit(df, "u", "x", "y").count() == 0
