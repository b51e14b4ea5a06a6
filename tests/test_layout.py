from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from calibra.operators import layout as L


def by_loops(item, count):
    """The layout of an item by plain loops."""

    def number(text, at):
        return int(hashlib.md5(text.encode()).hexdigest()[at - 1 : at + 6], 16)

    def within(n, low, high):
        return low + (n * (high - low) >> 28)

    for attempt in range(L.ATTEMPTS):
        placed = []
        for minus, disc in sorted((-within(number(f"{item}:{attempt}:{d}", 1), *L.RADIUS), d) for d in range(count)):
            r, edge = -minus, L.BORDER - minus
            for k in range(L.TRIES):
                text = f"{item}:{attempt}:{disc}:{k}"
                x, y = within(number(text, 1), edge, L.WIDTH - edge), within(number(text, 8), edge, L.HEIGHT - edge)
                if all((x - a) ** 2 + (y - b) ** 2 >= (r + s + L.GAP) ** 2 for _, s, a, b in placed):
                    placed.append((disc, r, x, y))
                    break
            else:
                break
        if len(placed) == count:
            return attempt, placed
    return None


def placed_by(df):
    got = defaultdict(list)
    for r in L.layouts(df, "i", "n")[0].collect():
        got[r["i"], r["attempt"]].append((r["disc"], r["r"], r["x"], r["y"]))
    return dict(got)


@pytest.mark.parametrize("parts", [1, 7])
def test_same_as_loops_on_any_partitioning(spark, parts):
    data = [(i, i % 8 + 1) for i in range(80)]
    got = placed_by(spark.createDataFrame(data, "i long, n int").repartition(parts))
    want = {(i, a): d for i, n in data for a, d in [by_loops(i, n)]}
    assert got == want
    for discs in got.values():
        for k, (_, r, x, y) in enumerate(discs):
            assert r + L.BORDER <= x <= L.WIDTH - r - L.BORDER and r + L.BORDER <= y <= L.HEIGHT - r - L.BORDER
            assert all(math.hypot(x - a, y - b) >= r + s + L.GAP for _, s, a, b in discs[:k])


def test_a_crowded_frame_takes_later_attempts_or_is_reported(spark, monkeypatch):
    monkeypatch.setattr(L, "WIDTH", 200_000)
    monkeypatch.setattr(L, "HEIGHT", 200_000)
    monkeypatch.setattr(L, "TRIES", 16)
    monkeypatch.setattr(L, "ATTEMPTS", 3)
    df = spark.createDataFrame([(i, 4) for i in range(60)], "i long, n int")
    want = {i: by_loops(i, 4) for i in range(60)}
    assert len({w[0] for w in want.values() if w}) > 1 and None in want.values()
    assert placed_by(df) == {(i, w[0]): w[1] for i, w in want.items() if w}
    assert {r["i"] for r in L.layouts(df, "i", "n")[1].collect()} == {i for i, w in want.items() if not w}


def test_nulls_zero_and_empty(spark):
    df = spark.createDataFrame([(None, 2), (1, None), (2, 0), (3, 1), (3, 1)], "i long, n int")
    rows, unplaced = L.layouts(df, "i", "n")
    assert [r["i"] for r in rows.collect()] == [3, 3] and unplaced.count() == 0
    assert L.layouts(df.limit(0), "i", "n")[0].count() == 0


def test_balanced(spark):
    rows = L.balanced(spark.range(101).withColumnRenamed("id", "i"), "i", 8).collect()
    sizes = Counter(r["value"] for r in rows)
    assert sorted(sizes) == list(range(1, 9)) and set(sizes.values()) == {12, 13}
    again = L.balanced(spark.range(101).repartition(5).withColumnRenamed("id", "i"), "i", 8)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_plan_has_no_shuffle_and_no_python(spark):
    df = spark.range(10).withColumn("n", F.lit(3)).withColumnRenamed("id", "i")
    plan = L.layouts(df, "i", "n")[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
