"""Every part is distorted by every kernel, as one by one."""
from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest

from calibra.operators import pixels
from calibra.plans import catalog

SF = "/root/testdata/sf0.001"


def test_kernels_same_as_one_by_one(spark):
    got = {(r["item_id"], r["kernel"]): (r["mean"], r["deviation"]) for r in catalog.QUERIES["pixel_kernels"](spark, SF).collect()}
    ids = pq.read_table(f"{SF}/part.parquet", columns=["p_partkey"])["p_partkey"].to_pylist()
    y, z = np.mgrid[0:32, 0:32] / 32
    want = {}
    for i in ids:
        f = np.random.default_rng(i).uniform(1, 9, (3, 2))
        picture = np.clip(127 + 100 * np.stack([np.sin(a * y * 6 + b * z * 6) for a, b in f], axis=-1), 0, 255)
        for name, kernel in pixels.KERNELS.items():
            x = np.clip(kernel(picture, pixels.LEVELS[name][2], np.random.default_rng(i)), 0, 255)
            want[i, name] = (round(float(x.mean()), 6), round(float(x.std()), 6))
    assert len(want) == len(ids) * 25 and got == want


def test_features_by_plain_loops(spark):
    got = catalog.QUERIES["pixel_features"](spark, SF).orderBy("item_id").first()
    f = np.random.default_rng(got["item_id"]).uniform(1, 9, (3, 2))
    y, z = np.mgrid[0:32, 0:32] / 32
    x = np.clip(127 + 100 * np.stack([np.sin(a * y * 6 + b * z * 6) for a, b in f], axis=-1), 0, 255)
    g = np.round(x @ np.array([0.299, 0.587, 0.114]))
    at = lambda i, j: g[min(max(i, 0), 31), min(max(j, 0), 31)]
    lap = np.array([[at(i - 1, j) + at(i + 1, j) + at(i, j - 1) + at(i, j + 1) - 4 * at(i, j) for j in range(32)] for i in range(32)])
    slope = np.array([[np.hypot(sum(w * (at(i + d, j + 1) - at(i + d, j - 1)) for d, w in ((-1, 1), (0, 2), (1, 1))), sum(w * (at(i + 1, j + d) - at(i - 1, j + d)) for d, w in ((-1, 1), (0, 2), (1, 1)))) for j in range(32)] for i in range(32)])
    box = np.array([[np.mean([at2(g, i + a, j + b) for a in range(-4, 4) for b in range(-4, 4)]) for j in range(32)] for i in range(32)])
    mask = [[1, -2, 1], [-2, 4, -2], [1, -2, 1]]
    noise = sum(abs(sum(mask[a][b] * g[i + a, j + b] for a in range(3) for b in range(3))) for i in range(30) for j in range(30)) * np.sqrt(np.pi / 2) / (6 * 30 * 30)
    cols = [abs(g[i, j + 1] - g[i, j]) for j in range(31) for i in range(32) if (j + 1) % 8 == 0]
    inner = [abs(g[i, j + 1] - g[i, j]) for j in range(31) for i in range(32) if (j + 1) % 8]
    want = {"lap_var": lap.var(), "tenengrad": (slope**2).mean(), "edge_mean_mag": slope.mean(), "local_contrast_mean": np.abs(g - box).mean(), "local_contrast_std": (g - box).std(), "noise_sigma": noise, "noise_sigma_log": np.log1p(noise), "blockiness_col": np.mean(cols) - np.mean(inner), "lum_p50": np.percentile(g, 50), "rms_contrast": g.std() / (g.mean() + 1e-6)}
    for k, v in want.items():
        assert abs(got[k] - v) < 1e-5 * max(1, abs(v)), k
    assert len(got) == 30


def at2(g, i, j):
    """A value with mirrored edges."""
    n = len(g)
    i, j = (-k - 1 if k < 0 else 2 * n - 1 - k if k >= n else k for k in (i, j))
    return g[i, j]


def test_levels_grow(spark):
    """Each distortion moves a picture further from what it was, level by level, in the mean over pictures."""
    g = np.random.default_rng(5)
    y, z = np.mgrid[0:64, 0:64] / 64
    for name, levels in pixels.LEVELS.items():
        moved = np.zeros(len(levels))
        for seed in range(6):
            f = g.uniform(1, 9, (3, 2))
            x = np.clip(127 + 100 * np.stack([np.sin(a * y * 6 + b * z * 6) for a, b in f], axis=-1), 0, 255)
            moved += [np.abs(pixels.degrade(x, name, k, seed) - x).mean() for k in range(len(levels))]
        assert moved[-1] > moved[0] and (moved[1:] > 0).all(), name


def test_stacks_are_single_pictures():
    """Every kernel at every level, and every feature, of a stack are those of its pictures by themselves."""
    from calibra.operators import pixel_stacks

    ids = np.array([3, 70, 100_000_007])
    x, draws = pixel_stacks.pictures(ids, 32), pixel_stacks.Draws(ids, 32)
    for name, levels in pixels.LEVELS.items():
        for k, value in enumerate(levels):
            got = pixel_stacks.degrade(x, name, value, draws)
            for j, i in enumerate(ids):
                assert np.abs(got[..., j] - pixels.degrade(x[..., j], name, k, int(i))).max() < 1e-9, (name, k)
    both, alone = pixel_stacks.features(x), [pixel_stacks.features(x[..., j : j + 1]) for j in range(3)]
    assert all(both[n][j] == pytest.approx(alone[j][n][0], rel=1e-12) for n in both for j in range(3))


def test_few_part_files_are_spread(spark):
    """The features of one small file of parts are made by many tasks."""
    assert catalog.QUERIES["pixel_features"](spark, SF).rdd.getNumPartitions() == 4


def test_rows_may_ask_for_different_kernels(spark):
    rows = pixels.pictures(spark.range(5).withColumnRenamed("id", "item_id"))
    from pyspark.sql import functions as F

    asked = rows.withColumn("kernels", F.when(F.col("item_id") % 2 == 0, F.array(F.lit("jitter"), F.lit("denoise"))).when(F.col("item_id") == 1, F.array(F.lit("denoise"))).otherwise(F.array().cast("array<string>")))
    got = {(r["item_id"], r["kernel"]): r["mean"] for r in pixels.distort(asked).collect()}
    assert set(got) == {(i, k) for i in (0, 2, 4) for k in ("jitter", "denoise")} | {(1, "denoise")}
    whole = {r["item_id"]: r["mean"] for r in pixels.distort(rows.withColumn("kernels", F.array(F.lit("denoise")))).collect()}
    assert all(got[i, "denoise"] == whole[i] for i in (0, 1, 2, 4))


def test_a_stack_of_one_picture(spark):
    """The last stack of a part can hold one picture, in Arrow's own read-only memory; no kernel writes into what it is given."""
    from calibra.operators import pixel_stacks

    x, draws = pixel_stacks.pictures(np.array([70]), 32), pixel_stacks.Draws(np.array([70]), 32)
    x.flags.writeable = False
    for name, levels in pixels.LEVELS.items():
        for k, value in enumerate(levels):
            got = pixel_stacks.degrade(x, name, value, draws)
            assert np.abs(got[..., 0] - pixels.degrade(x[..., 0], name, k, 70)).max() < 1e-9, (name, k)
    from pyspark.sql import functions as F

    asked = pixels.pictures(spark.range(70, 71, numPartitions=1).withColumnRenamed("id", "item_id")).withColumn("kernels", F.array(*map(F.lit, sorted(pixels.KERNELS))))
    got = {r["kernel"]: (r["mean"], r["deviation"]) for r in pixels.distort(asked).collect()}
    made = {n: pixels.degrade(x[..., 0], n, 2, 70) for n in pixels.KERNELS}
    assert got == {n: (round(float(v.mean()), 6), round(float(v.std()), 6)) for n, v in made.items()}
