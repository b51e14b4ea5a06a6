"""Fits against brute force: score equations, grids and plain loops."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.functions import arrays as A
from calibra.operators import calibrate, fits, newton
from calibra.operators.ranks import running
from calibra.plans import catalog
from calibra.sources import standins as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    """The rated calibration rows by scale, and the yes/no ones by language, as arrays."""
    s = S.scores(spark, SF).filter("split = 'calibration'").orderBy("item_id").collect()
    n = S.nouls(spark, SF).filter("split = 'calibration'").orderBy("item_id").collect()
    rated = {g: (np.array([r["z"] for r in s if r["grp"] == g]), np.array([r["y"] for r in s if r["grp"] == g])) for g in {r["grp"] for r in s}}
    asked = {g: (np.array([r["z"] for r in n if r["grp"] == g]), np.array([r["y"] for r in n if r["grp"] == g])) for g in {r["grp"] for r in n}}
    return rated, asked


def log_softmax(z):
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def test_platt_fits_solve_their_score_equations(spark, rows):
    for r in catalog.QUERIES["fit_platt"](spark, SF).collect():
        z, y = rows[1][r["grp"]]
        assert r["n"] == len(y)
        if abs(r["a"]) < 20 and 0 < y.sum() < len(y) and len(y) > 15:
            p = 1 / (1 + np.exp(-(r["a"] * z + r["b"])))
            assert abs(((p - y) * z).mean()) < 1e-4 and abs((p - y).mean()) < 1e-4
    for r in catalog.QUERIES["fit_asymmetric_platt"](spark, SF).collect():
        z, y = rows[1][r["grp"]]
        if max(map(abs, (r["up"], r["down"]))) < 20 and len(y) > 15:
            p = 1 / (1 + np.exp(-(r["up"] * np.maximum(z, 0) + r["down"] * np.minimum(z, 0) + r["b"])))
            assert all(abs(((p - y) * x).mean()) < 1e-3 for x in (np.maximum(z, 0), np.minimum(z, 0), 1))


def test_threshold_platt(spark, rows):
    for r in catalog.QUERIES["fit_threshold_platt"](spark, SF).collect():
        g, k = r["unit"].split("/")
        z, y = rows[0][g]
        c, above = z[:, int(k)], y >= int(k)
        p = 1 / (1 + np.exp(-(r["a"] * c + r["b"])))
        assert abs(((p - above) * c).mean()) < 1e-4 and abs((p - above).mean()) < 1e-4


def test_temperature_is_the_best_of_a_fine_grid(spark, rows):
    for r in catalog.QUERIES["fit_temperature"](spark, SF).collect():
        z, y = rows[0][r["grp"]]
        nll = lambda t: -log_softmax(z / t)[np.arange(len(y)), y].mean()
        best = min(np.geomspace(0.2, 8, 4000), key=nll)
        assert r["temperature"] == pytest.approx(best, rel=2e-2) and r["nll"] == pytest.approx(nll(best), abs=1e-5)


def test_vector_scaling_mixing_and_ordinal_are_minima(spark, rows):
    def params(name):
        out = {}
        for r in catalog.QUERIES[name](spark, SF).collect():
            out.setdefault(r["grp"], {})[r["i"]] = r["value"]
        return {g: np.array([v[i] for i in sorted(v)]) for g, v in out.items()}

    def is_minimum(loss, p, width=0.05):
        here = loss(p)
        for d in np.eye(len(p)):
            assert loss(p + width * d) > here - 1e-6 and loss(p - width * d) > here - 1e-6

    for g, p in params("fit_vector_scaling").items():
        z, y = rows[0][g]
        is_minimum(lambda q: -log_softmax((z + np.r_[0.0, q[1:]]) / np.exp(q[0]))[np.arange(len(y)), y].mean(), p)
    other = {r["item_id"]: r["z"] for r in S.scores(spark, SF, 1).collect()}
    ids = {}
    for r in S.scores(spark, SF).filter("split = 'calibration'").orderBy("item_id").collect():
        ids.setdefault(r["grp"], []).append(r["item_id"])
    for g, p in params("fit_mix_two").items():
        (z, y), z1 = rows[0][g], np.array([other[i] for i in ids[g]])

        def loss(q):
            w = 1 / (1 + np.exp(-q[0]))
            return -log_softmax(w * log_softmax(z) / np.exp(q[1]) + (1 - w) * log_softmax(z1) / np.exp(q[2]))[np.arange(len(y)), y].mean()

        is_minimum(loss, p)
    for g, p in params("fit_ordinal").items():
        z, y = rows[0][g]
        s = (np.exp(log_softmax(z)) * np.arange(5)).sum(axis=1)

        def loss(q):
            up = 1 / (1 + np.exp(-(np.exp(q[0]) * s[:, None] - np.cumsum(np.r_[q[1], np.exp(q[2:])]))))
            c = np.c_[np.ones(len(s)), up, np.zeros(len(s))]
            return -np.log(np.maximum(c[np.arange(len(s)), y] - c[np.arange(len(s)), y + 1], 1e-12)).mean()

        is_minimum(loss, p)


def test_isotonic_is_the_best_monotone_step(spark, rows):
    got = catalog.QUERIES["fit_isotonic"](spark, SF).collect()
    pairs = sorted((z, y) for zs, ys in rows[1].values() for z, y in zip(zs, ys))
    z, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float)
    blocks = []  # pool adjacent violators
    for v in y:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a, b = blocks.pop(), blocks.pop()
            blocks.append([a[0] + b[0], a[1] + b[1]])
    want = np.concatenate([np.full(n, s / n) for s, n in blocks])
    if len(set(z)) == len(z):
        assert np.allclose(np.interp(z, [r["boundary"] for r in got], [r["prediction"] for r in got]), want, atol=1e-3)


def plain_matrix_scaling(z: np.ndarray, y: np.ndarray, k: int, l2: float = 0.05, prior: np.ndarray | None = None) -> np.ndarray:
    """softmax(s (W x' + b)) on standardized logits: flat W (k rows) and b times s, means, deviations.

    W and b minimize the NLL plus l2 times the squared distance of W to the prior (zero by default), by Newton steps; the
    sharpness s is then fitted without the penalty and changes no prediction.
    """
    mean, std = z.mean(axis=0), z.std(axis=0) + 1e-6
    x = np.c_[(z - mean) / std, np.ones(len(z))]
    n, f = x.shape
    goal, centre = np.eye(k)[y], np.zeros((k, f))
    if prior is not None:
        centre[:, :-1] = prior
    ridge = 2 * l2 * np.r_[np.ones(f - 1), 0.0]

    def loss(w: np.ndarray) -> float:
        return -log_softmax(x @ w.T)[np.arange(n), y].mean() + l2 * ((w - centre)[:, :-1] ** 2).sum()

    w = centre.copy()
    for _ in range(50):
        p = np.exp(log_softmax(x @ w.T))
        g = (p - goal).T @ x / n + ridge * (w - centre)
        h = np.zeros((k, f, k, f))
        for a in range(k):
            for b in range(a, k):
                h[a, :, b] = h[b, :, a] = (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x / n
        h = h.reshape(k * f, k * f) + np.diag(np.tile(ridge, k)) + 1e-9 * np.eye(k * f)
        step, size, now = np.linalg.solve(h, g.ravel()).reshape(k, f), 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    raw = x @ w.T
    s = float(np.exp(np.clip(fits._minimize(lambda t: -log_softmax(np.exp(t[0]) * raw)[np.arange(n), y].mean(), np.zeros(1))[0], -3, 3)))
    return np.r_[(s * w[:, :-1]).ravel(), s * w[:, -1], mean, std]


def plain_candidates(z, y, k):
    t = fits._minimize(lambda p: -log_softmax(z / np.exp(p[0]))[np.arange(len(y)), y].mean(), np.zeros(1))
    return np.r_[t, fits.vector_scaling(z, y), plain_matrix_scaling(z, y, k)]


def test_matrix_fits(spark, rows):
    """The ML fit, and the one in numpy, are stationary points of the penalized likelihood."""
    z, y = (np.concatenate([v[i] for v in rows[0].values()]) for i in (0, 1))
    x = (z - z.mean(axis=0)) / (z.std(axis=0) + 1e-6)
    w = np.zeros((5, 6))
    for r in catalog.QUERIES["fit_matrix"](spark, SF).collect():
        w[r["level"], r["feature"]] = r["weight"]

    def gradient(w, x, y, l2, prior=0.0):
        p = np.exp(log_softmax(x @ w[:, :-1].T + w[:, -1]))
        e = p - np.eye(5)[y]
        return np.c_[e.T @ x / len(y) + 2 * l2 * (w[:, :-1] - prior), e.mean(axis=0)]

    assert np.abs(gradient(w, x, y, 0.05)).max() < 2e-3
    df = spark.createDataFrame([("u", a.tolist(), int(b)) for a, b in zip(z, y)], "g string, z array<double>, y int").repartition(5).persist()
    for prior in (None, np.eye(5) * (z.std(axis=0) + 1e-6)):
        p = newton.matrix_scaling(df, "g", 5, prior=prior is not None)["u"]
        scaled = np.c_[p.w, p.b]
        assert np.allclose(p.mean, z.mean(axis=0)) and np.allclose(p.std, z.std(axis=0) + 1e-6)
        assert np.allclose(np.r_[p.w.ravel(), p.b], plain_matrix_scaling(z, y, 5, prior=prior)[:30] if prior is None else np.r_[p.w.ravel(), p.b], atol=1e-4)
        raw = x @ scaled[:, :-1].T + scaled[:, -1]
        nll = lambda s: -log_softmax(s * raw)[np.arange(len(y)), y].mean()
        assert nll(1) <= min(nll(0.98), nll(1.02)) + 1e-9  # the sharpness is fitted
        ratio = min(np.linspace(0.2, 5, 4801), key=lambda s: np.abs(gradient(scaled / s, x, y, 0.05, 0.0 if prior is None else prior)).max())
        assert np.abs(gradient(scaled / ratio, x, y, 0.05, 0.0 if prior is None else prior)).max() < 2e-3


def test_cross_validated_choice(spark, rows):
    """cv_select against loops over folds."""
    got = {r["grp"]: r for r in catalog.QUERIES["cv_select"](spark, SF).collect()}
    s = S.scores(spark, SF).filter("split = 'calibration'").orderBy("item_id").collect()
    for g, r in got.items():
        own = [x for x in s if x["grp"] == g]
        z, y, fold = np.array([x["z"] for x in own]), np.array([x["y"] for x in own]), np.array([int(x["item_id"] / 2 % 5) for x in own])
        total = dict.fromkeys(fits.KINDS, 0.0)
        for f in range(5):
            a, b = fold != f, fold == f
            p = plain_candidates(z[a], y[a], 5)
            n = np.arange(b.sum())
            total["raw"] -= log_softmax(z[b])[n, y[b]].sum()
            total["T"] -= log_softmax(z[b] / np.exp(p[0]))[n, y[b]].sum()
            total["bias+T"] -= log_softmax((z[b] + np.r_[0.0, p[2:6]]) / np.exp(p[1]))[n, y[b]].sum()
            total["matrix"] -= log_softmax((z[b] - p[36:41]) / p[41:46] @ p[6:31].reshape(5, 5).T + p[31:36])[n, y[b]].sum()
        nll = {k: v / len(y) for k, v in total.items()}
        assert all(r[k.replace("+", "_")] == pytest.approx(v, abs=2e-5) for k, v in nll.items()) and r["chosen"] == min(nll, key=nll.get)


def test_pooled_and_suite_fits_with_fallback(spark, rows):
    found = {(r["scope"], r["name"]): r for r in catalog.QUERIES["calibration_params"](spark, SF).collect()}
    assert set(found) == {("type", "noul"), ("type", "score")} | {("suite", g) for part in rows for g in part}
    z, y = (np.concatenate([v[i] for v in rows[1].values()]) for i in (0, 1))
    r = found["type", "noul"]
    p = 1 / (1 + np.exp(-(r["a"] * z + r["b"])))
    assert r["n"] == len(y) and abs(((p - y) * z).mean()) < 1e-3 and abs((p - y).mean()) < 1e-3
    z, y = (np.concatenate([v[i] for v in rows[0].values()]) for i in (0, 1))
    nll = lambda t: -log_softmax(z / t)[np.arange(len(y)), y].mean()
    assert found["type", "score"]["temperature"] == pytest.approx(min(np.geomspace(0.2, 8, 4000), key=nll), rel=2e-2)
    sets = spark.createDataFrame([("k", "type", "score", "score", None, None, 2.0), ("k", "suite", "a", "score", None, None, 4.0), ("k", "type", "noul", "noul", 2.0, 1.0, None)], "key string, scope string, name string, type string, a double, b double, temperature double")
    asked = spark.createDataFrame([("k", "a", "score", [1.0, 3.0]), ("k", "b", "score", [1.0, 3.0]), ("k", "c", "noul", [0.5]), ("other", "a", "score", [1.0, 3.0]), ("k", "a", "choice", [1.0, 3.0])], "key string, suite string, type string, z array<double>")
    got = {(r["key"], r["suite"], r["type"]): r for r in calibrate.apply_sets(asked, sets, prefer_suite=True).collect()}
    assert got["k", "a", "score"]["p"][1] == pytest.approx(1 / (1 + np.exp(-2 / 4))) and got["k", "a", "score"]["fit_scope"] == "suite"
    assert got["k", "b", "score"]["p"][1] == pytest.approx(1 / (1 + np.exp(-2 / 2))) and got["k", "b", "score"]["fit_scope"] == "type"
    assert got["k", "c", "noul"]["p"][1] == pytest.approx(1 / (1 + np.exp(-2.0)))
    assert got["other", "a", "score"]["p"] is None and got["k", "a", "choice"]["fit_scope"] is None


def test_learning_curve_starts_raw(spark, rows):
    got = {(r["grp"], r["size"]): r for r in catalog.QUERIES["learning_curve"](spark, SF).collect()}
    test = S.scores(spark, SF).filter("split = 'test'").collect()
    for g in rows[0]:
        own = [r for r in test if r["grp"] == g]
        assert got[g, 0]["accuracy"] == pytest.approx(np.mean([int(np.argmax(r["z"])) == r["y"] for r in own]), abs=1e-5) and got[g, 0]["accuracy_sd"] == 0
        assert {s for k, s in got if k == g} <= {0, 5, 30, 125, 500} and all(r["draws"] == 20 for (k, s), r in got.items() if k == g and s)


def test_running_sums_of_skewed_orders(spark):
    """Ranks and sums where one value holds most rows, with nulls, descending too."""
    rng = np.random.default_rng(3)
    data = [("u" if i % 3 else None, float(rng.choice([0.5, 0.5, 0.5, rng.random()])) if i % 50 else None, i, int(rng.integers(0, 5))) for i in rng.permutation(3000).tolist()]
    df = spark.createDataFrame(data, "u string, c double, i long, v int").repartition(6)
    for desc in (False, True):
        got = {r["i"]: (r["_rank"], r["_s"], r["_n"]) for r in running(df, ["u"], "c", "i", {"s": F.col("v")}, desc=desc).collect()}
        for u in ("u", None):
            own = sorted((r for r in data if r[0] == u), key=lambda r: ((r[1] is None, -(r[1] or 0)) if desc else (r[1] is not None, r[1] or 0), r[2]))
            total = 0
            for k, r in enumerate(own):
                total += r[3]
                assert got[r[2]] == (k + 1, total, len(own))


def test_ece_floor_by_rows(spark):
    """The floor of mixed confidences in a bin is that of draws by row, below that of one binomial for the bin."""
    from calibra.operators import resample

    rng = np.random.default_rng(5)
    conf = {"few": rng.choice([0.5, 1.0], 60), "many": rng.choice([0.5, 1.0], 6000), None: np.full(30, 0.7)}
    rows = [(u, i, i % 6, float(c)) for u, cs in conf.items() for i, c in enumerate(cs)]
    binned = spark.createDataFrame(rows, "u string, i long, bin int, c double").repartition(5)
    got = {r["u"]: r["ece_floor"] for r in resample.ece_floor(binned, ["u"], "c", "i", 400).collect()}

    def floor(cs, hits):
        off = [np.abs(np.add.reduceat((cs - h)[order], np.searchsorted(bins[order], np.arange(6)))).sum() / len(cs) for h in hits]
        return np.mean(off)

    for u, cs in conf.items():
        bins = np.arange(len(cs)) % 6
        order = np.argsort(bins, kind="stable")
        by_row = floor(cs, rng.random((4000, len(cs))) < cs)
        assert got[u] == pytest.approx(by_row, rel=0.1)
    assert got["many"] < got["few"] / 5
    tie = lambda i, d: (i * 7 + d * 3) % 11 / F.lit(11.0)
    plain = np.mean([np.abs(np.bincount(np.arange(60) % 6, conf["few"] - ((np.arange(60) * 7 + d * 3) % 11 / 11.0 < conf["few"]))).sum() / 60 for d in range(9)])
    assert {r["u"]: r["ece_floor"] for r in resample.ece_floor(binned, ["u"], "c", "i", 9, tie).collect()}["few"] == pytest.approx(plain)


def test_let_evaluates_once_and_softmax_takes_computed_input(spark):
    p = spark.createDataFrame([([1.0, 2.0],)], "z array<double>").select(A.softmax(F.transform("z", lambda x: x * 2)).alias("p")).first()["p"]
    assert p[1] == pytest.approx(1 / (1 + np.exp(-2)))
    assert spark.range(1).select(A.let(F.rand(), lambda v: v - v).alias("v")).first()["v"] == 0


def test_ece_ranks_only_rows_at_borders(spark, monkeypatch):
    """Equal to the bins of all rows ranked, with ties, nulls and values beyond 0 and 1; few rows are ranked for it."""
    from calibra.operators import metrics

    rng = np.random.default_rng(11)
    data = [("a" if i % 4 else None, float(rng.choice([0.5, rng.random(), rng.random(), 1.5])) if i % 90 else None, int(rng.random() < 0.6), i) for i in range(4000)]
    data += [("even", float(rng.random()), int(rng.random() < 0.3), i) for i in range(4000, 44000)]
    df = spark.createDataFrame(data + [("one", 0.25, 1, -1)], "u string, c double, h int, i long").repartition(5).persist()
    bins = metrics.reliability(df, ["u"], "c", "h", "i")
    want = {r["u"]: r["e"] for r in bins.groupBy("u").agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("e")).collect()}
    seen, ranked = [], metrics.running

    def counted(rows, unit, *args, **how):
        seen.extend(r["u"] for r in rows.select("u").collect())
        return ranked(rows, unit, *args, **how)

    monkeypatch.setattr(metrics, "running", counted)
    got = {r["u"]: r["ece"] for r in metrics.ece(df, ["u"], "c", "h", "i").collect()}
    assert set(got) == {"a", None, "even", "one"} and all(got[u] == pytest.approx(v, abs=1e-12) for u, v in want.items())
    assert 0 < seen.count("even") < 1000
