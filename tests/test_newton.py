"""Distributed Newton fits against plain numpy on all rows at once."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import newton
from calibra.plans import catalog


def log_softmax(z):
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@pytest.fixture(scope="module")
def data():
    """Groups of unlike sizes: (z, second z, y) of each, one with a null key."""
    rng, out = np.random.default_rng(1), {}
    for unit, n in (("a", 900), ("b", 60), (None, 300)):
        y = rng.integers(0, 4, n)
        z, z1 = (2.0 * np.eye(4)[y] * scale + rng.normal(size=(n, 4)) + np.array([0, 1, 0, -1]) for scale in (1, 0.4))
        out[unit] = (z, z1, y)
    return out


@pytest.fixture(scope="module")
def table(spark, data):
    rows = [(u, i, z.tolist(), z1.tolist(), int(y)) for u, (zs, z1s, ys) in data.items() for i, (z, z1, y) in enumerate(zip(zs, z1s, ys))]
    return spark.createDataFrame(rows, "g string, i int, z array<double>, z1 array<double>, y int").repartition(7).persist()


def least(loss, p, width=1e-3):
    """p is a minimum: no step along an axis or a random direction goes down."""
    here, rng = loss(p), np.random.default_rng(0)
    return all(loss(p + s * width * d) >= here - 1e-10 for d in [*np.eye(len(p)), *rng.normal(size=(20, len(p)))] for s in (1, -1))


def test_vector_scaling_and_temperature(table, data):
    v, t = newton.vector_scaling(table, "g", 4), newton.temperature(table, "g")
    assert set(v) == set(t) == set(data)
    for u, (z, _, y) in data.items():
        at = np.arange(len(y))
        assert least(lambda p: -log_softmax((z + np.r_[0.0, p[1:]]) / np.exp(p[0]))[at, y].mean(), v[u].w)
        assert least(lambda p: -log_softmax(z / np.exp(p[0]))[at, y].mean(), t[u].w)
        assert v[u].n == len(y) and v[u].loss == pytest.approx(-log_softmax((z + np.r_[0.0, v[u].w[1:]]) / np.exp(v[u].w[0]))[at, y].mean())


def test_useless_scores_end_at_the_bound(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 200)
    rows = [("u", (-3 * np.eye(3)[k]).tolist(), int(k)) for k in y]
    fit = newton.vector_scaling(spark.createDataFrame(rows, "g string, z array<double>, y int").persist(), "g", 3)["u"]
    assert fit.w[0] == pytest.approx(newton.LOG_T[1])


def test_mix(table, data):
    for u, f in newton.mix_two(table, "g").items():
        z, z1, y = data[u]

        def loss(p):
            w = 1 / (1 + np.exp(-p[0]))
            return -log_softmax(w * log_softmax(z) / np.exp(p[1]) + (1 - w) * log_softmax(z1) / np.exp(p[2]))[np.arange(len(y)), y].mean()

        assert least(loss, f.w) and f.w[1] == f.w[2]


def test_ordinal(spark, data):
    rng = np.random.default_rng(3)
    s = {u: y + rng.normal(size=len(y)) for u, (_, _, y) in data.items()}
    df = spark.createDataFrame([(u, float(x), int(k)) for u in data for x, k in zip(s[u], data[u][2])], "g string, s double, y int").persist()
    for u, f in newton.ordinal(df, "g", 4).items():
        y = data[u][2]

        def loss(p):
            c = np.c_[np.ones(len(y)), 1 / (1 + np.exp(-(p[0] * s[u][:, None] - p[1:]))), np.zeros(len(y))]
            return -np.log(np.maximum(c[np.arange(len(y)), y] - c[np.arange(len(y)), y + 1], 1e-300)).mean()

        assert least(loss, f.w, 1e-4) and f.loss == pytest.approx(loss(f.w)) and (np.diff(f.w[1:]) > 0).all()


def test_ordinal_derivatives():
    rng = np.random.default_rng(4)
    rows, w, e = {"s": rng.normal(size=50), "y": rng.integers(0, 5, 50)}, np.array([0.7, -1.0, -0.2, 0.4, 1.5]), 1e-5
    loss, g, h = newton.Ordinal().sums("u", rows, w)
    at = lambda v: newton.Ordinal().sums("u", rows, v)
    assert np.allclose(g, [(at(w + e * d)[0] - at(w - e * d)[0]) / (2 * e) for d in np.eye(5)], atol=1e-4)
    assert np.allclose(h, [(at(w + e * d)[1] - at(w - e * d)[1]) / (2 * e) for d in np.eye(5)], atol=1e-4)


def plain_sharpness(logits, y):
    return min(np.exp(np.linspace(-3, 3, 60001)), key=lambda s: -log_softmax(s * logits)[np.arange(len(y)), y].mean())


@pytest.mark.parametrize("prior", [False, True])
def test_held_out_sharpness(spark, table, data, prior):
    """The scalar of held-out logits, each fold fitted apart."""
    both = table.selectExpr("g", "i", "concat(z, z1) as z", "y", "xxhash64(i) as h").persist()
    hashes = {r["i"]: r["h"] for r in both.select("i", "h").distinct().collect()}
    made, flat = newton.matrix_scaling(both, "g", 4, rescale="cv", tie="i", prior=prior), newton.matrix_scaling(both, "g", 4, rescale="none", prior=prior)
    for u, (z, z1, y) in data.items():
        x, fold = np.c_[z, z1], np.array([hashes[i] % 5 for i in range(len(y))])
        logits = np.zeros((len(y), 4))
        for f in range(5):
            part = spark.createDataFrame([("x", a.tolist(), int(b)) for a, b in zip(x[fold != f], y[fold != f])], "g string, z array<double>, y int").persist()
            logits[fold == f] = newton.matrix_scaling(part, "g", 4, rescale="none", prior=prior)["x"].logits(x[fold == f])
        assert made[u].sharpness == pytest.approx(plain_sharpness(logits, y), rel=1e-3)
        assert np.allclose(made[u].w, made[u].sharpness * flat[u].w)

        def loss(p):
            k, f = 4, 8
            std = x.std(axis=0) + 1e-6
            centre = np.hstack([np.eye(4)] * 2) / 2 * std if prior else 0.0
            w, b = p[: k * f].reshape(k, f), p[k * f :]
            return -log_softmax((x - x.mean(axis=0)) / std @ w.T + b)[np.arange(len(y)), y].mean() + 0.05 * ((w - centre) ** 2).sum()

        assert least(loss, np.r_[flat[u].w.ravel(), flat[u].b])


def test_sharpness_needs_two_folds(spark):
    rows = [("u", [1.0 * i, -1.0 * i], int(i > 8)) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, z array<double>, y int").persist()
    assert newton.matrix_scaling(df.withColumn("i", df.y), "g", 2, rescale="cv", tie="i")["u"].sharpness == 1.0
    assert newton.matrix_scaling(df, "g", 2)["u"].sharpness != 1.0


def test_levels_are_checked(spark):
    df = lambda ys: spark.createDataFrame([("u", [0.0], y) for y in ys], "g string, z array<double>, y int")
    assert newton.level_counts(df([0, 1, 1]), "g", 2) == {"u": [1, 2]}
    for ys in ([0, 0], [0, 1, 2], [0, None, 1], [-1, 0, 1]):
        with pytest.raises(ValueError, match="level"):
            newton.level_counts(df(ys), "g", 2)


def test_threshold_platt(table, data):
    cumulative = table.selectExpr("g", "slice(z, 2, 3) as z", "y")
    for u, p in newton.threshold_platt(cumulative, "g", 4).items():
        z, _, y = data[u]
        for j in range(3):
            q = 1 / (1 + np.exp(-(p[j, 0] * z[:, j + 1] + p[j, 1])))
            assert abs((q - (y > j)).mean()) < 1e-8 and abs(((q - (y > j)) * z[:, j + 1]).mean()) < 1e-8


def test_choice_among_cumulative_candidates(spark):
    got = {r["grp"]: r for r in catalog.QUERIES["cv_select_cumulative"](spark, "/root/testdata/sf0.001").collect()}
    assert all(r["chosen"] == min(("raw", "platt/threshold", "matrix"), key=lambda k: r[k.replace("/", "_")]) for r in got.values()) and len(got) == 3


def test_rounds_move_blocks_and_folds_add_no_rows(spark, data, table, monkeypatch):
    """rows were handed over one by one in every round, and a copy of each was kept for each fold."""
    moved, sums = [], newton.Blocks.sums

    def counted(self, names, each):
        moved.append(self.df.count())
        return sums(self, names, each)

    monkeypatch.setattr(newton.Blocks, "sums", counted)
    many = table.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19)))).persist()
    found = newton.matrix_scaling(many, "g", 4, rescale="cv", tie="i")
    assert max(moved) <= 30 and {u: f.n for u, f in found.items()} == {u: 20 * len(y) for u, (_, _, y) in data.items()}


def test_open_direction_of_the_biases_stays_at_its_start(table, data):
    """rounding moved the mean of the biases, which the loss leaves open, in the fifth digit."""
    both = table.withColumn("z", F.concat("z", "z1"))
    for u, m in newton.matrix_scaling(both, "g", 4, rescale="none", prior=True).items():
        z, z1, _ = data[u]
        assert m.b.mean() == pytest.approx((z.mean() + z1.mean()) / 2, abs=1e-12)
