"""Many fits of the same rows against plain loops, and that equal confidences are counted instead of ranked."""
from __future__ import annotations

import numpy as np
import pytest

from calibra.operators import variants

SCHEMA = "grp string, item_id long, y int, z array<double>"
FITS = {"a": [(0, [0.0] * 5), (1, [0.4, 0.3, -0.2, 0.9, 0.1]), (2, [-6.0, 0.0, 0.1, 0.2, 0.3])], "b": [(3, [0.0] * 5), (4, [9.0, 0.5, 0.0, -0.5, 1.0])], "c": [(5, [0.0] * 5)]}


def made(rows: int, patterns: int) -> list[tuple]:
    """Rows of two groups and of none; scores of a few patterns, of the row's own after those, and some rows without a label."""
    rng = np.random.default_rng(11)
    few = rng.normal(0, 2, (patterns, 5)).round(3)
    out = []
    for i in range(rows):
        z = few[i % patterns] if i % 3 or patterns < 3 else rng.normal(0, 2, 5)
        y = None if patterns > 2 and i % 41 == 0 else int(rng.integers(0, 5))
        out.append(("a" if i % 5 < 2 else "b" if i % 5 < 4 else None, int(i * 37 % rows), y, [None] * 5 if y is None else z.tolist()))
    return out


def plain(data: list[tuple]) -> dict[int, tuple]:
    out = {}
    for g, units in FITS.items():
        for unit, p in units:
            scored = []
            for _, i, y, z in (r for r in data if r[0] == g):
                if y is None:
                    scored.append((-1.0, i, None, None))
                    continue
                v = (np.array(z) + np.r_[0.0, p[1:]]).astype(float)
                best = int(np.argmax(v))
                e = np.exp((v - v.max()) / np.exp(p[0]))
                scored.append((round(1 / e.sum(), 9), i, int(best == y), abs(e @ np.arange(5) / e.sum() - y)))
            if not scored:
                continue
            scored.sort(key=lambda r: r[:2])
            gaps = 0.0
            for b in np.array_split(np.arange(len(scored)), min(15, len(scored))):
                some = [scored[j] for j in b if scored[j][2] is not None]
                gaps += len(b) * abs(np.mean([r[0] for r in some]) - np.mean([r[2] for r in some])) if some else 0.0
            known = [r for r in scored if r[2] is not None]
            out[unit] = (np.mean([r[2] for r in known]), np.mean([r[3] for r in known]), gaps / len(scored))
    return out


@pytest.mark.parametrize(("rows", "patterns"), [(3000, 7), (2000, 1), (9, 3), (40, 40)])
def test_quality_is_that_of_plain_loops(spark, monkeypatch, rows, patterns):
    monkeypatch.setattr(variants, "STRETCHES", 8)
    data = made(rows, patterns)
    got = {r["unit"]: (r["accuracy"], r["mae"], r["ece"]) for r in variants.quality(spark.createDataFrame(data, SCHEMA), FITS, 3).collect()}
    want = plain(data)
    assert got.keys() == want.keys()
    assert all(got[u] == pytest.approx(want[u], abs=1e-9) for u in want)


def test_equal_confidences_are_counted(spark, monkeypatch):
    """Rows of one confidence, which every border of bins cuts: a row for each stretch of the ids, and only rows of the cut stretches."""
    data = [("a", i, i % 5, [0.0, 1.0, 2.0, 0.0, 0.0]) for i in range(6000)]
    seen = {}
    running, rows_of = variants.running, variants._rows_of

    def counted(df, *args):
        seen["cells"] = df.count()
        return running(df, *args)

    def held(*args):
        found = rows_of(*args)
        seen["rows"] = found.count()
        return found

    monkeypatch.setattr(variants, "STRETCHES", 100)
    monkeypatch.setattr(variants, "running", counted)
    monkeypatch.setattr(variants, "_rows_of", held)
    got = variants.quality(spark.createDataFrame(data, SCHEMA), {"a": [(0, [0.0] * 5)]}, 3).collect()
    assert got[0]["ece"] == pytest.approx(plain(data)[0][2], abs=1e-9)
    assert seen["cells"] <= 100 and seen["rows"] <= 14 * 61 < 6000


def test_learning_curve_copies_no_row_for_each_fit(spark, monkeypatch):
    """Test rows meet the fits in the tasks: what is ranked by the ranks of the order are counts, not a row for each fit."""
    from calibra.operators import metrics, ranks
    from calibra.plans import catalog

    most = [0]

    def counted(df, *args, **kw):
        most[0] = max(most[0], df.count())
        return ranks.running(df, *args, **kw)

    monkeypatch.setattr(metrics, "running", counted)
    monkeypatch.setattr(variants, "running", counted)
    monkeypatch.setattr(variants, "STRETCHES", 16)
    catalog.QUERIES["learning_curve"](spark, "/root/testdata/sf0.01")
    assert 0 < most[0] < 100_000  # 7,500 rows under 81 fits each are 607,500
