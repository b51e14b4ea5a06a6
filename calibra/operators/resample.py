"""Bootstrap intervals and sampling floors. Clusters are summed first, so draws run over clusters and not over rows."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DRAWS = 2000
#: Clusters that are weighted at a time, and units whose sums a task holds before it passes them on.
CHUNK, UNITS = 256, 256
#: Draws that one row sums up side by side.
SIDE = 10
#: Poisson(1): a hash below the k-th bound has a weight of k or less.
_BOUNDS = np.array([int(p * 2**64) for p in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])], np.uint64)


def clustered(df: DataFrame, unit: list[str], cluster: str, value: str, other: str | None = None) -> DataFrame:
    """Sum and count of value (or of value - other where both are there) for each cluster of a unit."""
    v = F.col(value).cast("double") - F.col(other).cast("double") if other else F.col(value).cast("double")
    return df.groupBy(*unit, F.col(cluster).alias("cluster")).agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("s"), F.count(v).alias("n"))


def weights(hashes: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Poisson(1) weights (clusters x draws) that depend on hash, draw and seed only."""
    x = hashes.view(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xC2B2AE3D27D4EB4F % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return np.searchsorted(_BOUNDS, x ^ (x >> np.uint64(31)), side="right").astype(np.float64)


def cluster_bootstrap(df: DataFrame, unit: str, cluster: str, value: str, other: str | None = None, draws: int = DRAWS, seed: int = 7, stratum: str | None = None) -> DataFrame:
    """unit, mean, low, high of a mean (or of the mean difference value - other) over resampled clusters, and their number.

    Each draw weighs every cluster by a hashed Poisson(1) number; tasks sum over their clusters and Spark over the tasks,
    so no unit is gathered. With a stratum each is resampled by itself and counts as much in every draw as in the data.
    Draws without a value are left out.
    """
    strata = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")
    keys = [unit, "_stratum"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}

        def made() -> Iterator[pd.DataFrame]:
            for (u, k), (s, n, c) in sums.items():
                yield pd.DataFrame({unit: pd.Series([u] * (draws + 1), dtype=object), "_stratum": k, "draw": np.arange(-1, draws), "s": s, "n": n, "c": c})
            sums.clear()

        for pdf in batches:
            for (u, k), own in pdf.groupby(keys, dropna=False, sort=False):
                key = (None if pd.isna(u) else u, k)
                if key not in sums and len(sums) >= UNITS:
                    yield from made()
                total = sums.setdefault(key, [np.zeros(draws + 1), np.zeros(draws + 1), 0])
                total[2] += len(own)
                for i in range(0, len(own), CHUNK):
                    part = own.iloc[i : i + CHUNK]
                    w = weights(part["h"].to_numpy(np.int64), draws, seed)
                    for t, c in zip(total, ("s", "n")):
                        x = part[c].to_numpy(np.float64)
                        t[0] += x.sum()
                        t[1:] += x @ w
        yield from made()

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are narrow and draws cost time: spread them
    hashed = clustered(df.withColumn("_stratum", strata), keys, cluster, value, other).select(*keys, F.xxhash64("cluster").alias("h"), "s", "n").repartition(parts, "h")
    kind = df.schema[unit].dataType.simpleString()
    drawn = hashed.mapInPandas(run, f"`{unit}` {kind}, _stratum string, draw int, s double, n double, c long").groupBy(*keys, "draw").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("c").alias("c"))
    rows = F.max(F.when(F.col("draw") < 0, F.col("n"))).over(Window.partitionBy(*keys))  # a row for each draw
    some = drawn.withColumn("rows", F.when(F.col("n") > 0, rows)).groupBy(unit, "draw").agg(F.try_divide(F.sum(F.try_divide(F.col("rows") * F.col("s"), F.col("n"))), F.sum("rows")).alias("mean"), F.sum("c").alias("c"))
    mean, whole = F.col("mean"), F.col("draw") < 0
    found = some.groupBy(unit).agg(F.max(F.when(whole, mean)).alias("mean"), F.percentile(F.when(~whole, mean), F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.max(F.when(whole, F.col("c"))).alias("clusters"))
    return found.select(unit, "mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "clusters")


def hashed_uniform(tie: Column, draw: Column) -> Column:
    """A number in [0, 1) of a row and a draw, from a hash."""
    return F.pmod(F.xxhash64(tie, draw), F.lit(1 << 53)) / F.lit(float(1 << 53))


def ece_floor(binned: DataFrame, unit: list[str], conf: str, tie: str, draws: int = 200, uniform: Callable[[Column, Column], Column] = hashed_uniform) -> DataFrame:
    """unit, ece_floor: the mean ECE that rows right with just the probability they claim would show by chance.

    binned: rows with a confidence and a bin. In each draw a row is right if its uniform number lies below its confidence;
    tasks sum by bin and draw, SIDE draws in the columns of a row, and only the sums are shuffled.
    """
    drawn = binned.select(*unit, "bin", conf, tie, F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(SIDE))).alias("draw"))
    right = [(uniform(F.col(tie), F.col("draw") + j) < F.col(conf)).cast("double") for j in range(min(SIDE, draws))]
    sums = drawn.groupBy(*unit, "draw", "bin").agg(F.sum(conf).alias("c"), F.count("*").alias("n"), *(F.sum(h).alias(f"_h{j}") for j, h in enumerate(right)))
    bins = sums.select(*unit, F.col("draw").alias("_first"), "bin", "c", "n", F.posexplode(F.array(*(f"_h{j}" for j in range(len(right))))).alias("_j", "h")).withColumn("draw", F.col("_first") + F.col("_j")).filter(F.col("draw") < draws)
    each = bins.groupBy(*unit, "draw").agg((F.sum(F.abs(F.col("c") - F.col("h"))) / F.sum("n")).alias("ece"))
    return each.groupBy(*unit).agg(F.avg("ece").alias("ece_floor"))
