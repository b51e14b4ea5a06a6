"""Calibration fits. Sums over rows are Spark aggregates, steps on the few parameters of each group run on the driver.

The number of groups (suites, scales) is small by nature; rows are never collected, so a fit reads any number of them.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.functions import arrays as A

#: A weight of this size has run away: its group is separable and the fit stops there.
FAR = 25.0


def fit_logistic(df: DataFrame, key: str, features: list[str], y: str, ridge: float = 1e-9, rounds: int = 25) -> DataFrame:
    """Logistic regression per group by Newton steps: key, w (one per feature, then the intercept), n, nll."""
    spark, d = df.sparkSession, len(features) + 1
    df = df.select(key, *(F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)), F.col(y).cast("double").alias("_y")).persist()  # each round reads these rows; lost ones are made again
    x = [*(F.col(f"_x{i}") for i in range(d - 1)), F.lit(1.0)]
    y_ = F.col("_y")
    keys = [r[0] for r in df.select(key).distinct().collect()]
    w = {k: np.eye(d)[0] * (len(features) == 1) for k in keys}
    schema = f"_k {df.schema[key].dataType.simpleString()}, _w array<double>"

    def scored(state: dict) -> DataFrame:
        made = spark.createDataFrame([(k, v.tolist()) for k, v in state.items()], schema)
        z = sum((x[i] * F.col("_w")[i] for i in range(1, d)), x[0] * F.col("_w")[0])
        return df.join(F.broadcast(made), df[key].eqNullSafe(made["_k"])).withColumn("_z", z).withColumn("_p", A.sigmoid(F.col("_z")))

    loss = F.when(F.col("_z") > 0, F.col("_z") + F.log1p(F.exp(-F.col("_z")))).otherwise(F.log1p(F.exp(F.col("_z")))) - y_ * F.col("_z")
    live, open_, out = dict(w), dict(w), {}
    for _ in range(rounds):
        v = F.col("_p") * (1 - F.col("_p"))
        sums = [F.sum((F.col("_p") - y_) * x[i]).alias(f"g{i}") for i in range(d)] + [F.sum(v * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(d) for j in range(i + 1)]
        for r in scored(open_).groupBy("_k").agg(*sums, F.count("*").alias("n"), F.avg(loss).alias("nll")).collect():
            k = r["_k"]
            g = np.array([r[f"g{i}"] for i in range(d)]) + ridge * live[k]
            h = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)]) + ridge * np.eye(d)
            step = np.linalg.lstsq(h, g, rcond=None)[0]
            size = np.abs(step).max()
            live[k] = live[k] - step * min(1.0, 5.0 / max(size, 1e-300))
            out[k] = (live[k], r["n"], r["nll"])
            if size < 1e-7 or np.abs(live[k]).max() > FAR:  # done, or the classes can be told apart without error
                open_.pop(k, None)
            else:
                open_[k] = live[k]
        if not open_:
            break
    df.unpersist()
    rows = [(k, live[k].tolist(), int(n), float(loss_)) for k, (_, n, loss_) in out.items()]
    return spark.createDataFrame(rows, f"{key} {df.schema[key].dataType.simpleString()}, w array<double>, n long, nll double")


def fit_temperature(df: DataFrame, key: str, z: str, y: str, low: float = -5.0, high: float = 7.0, points: int = 9, rounds: int = 8) -> DataFrame:
    """The temperature of least NLL per group within exp(low) to exp(high): key, temperature, nll. Each pass tries several."""
    spark, given = df.sparkSession, df.schema[key].dataType.simpleString()
    df = df.select(key, A.centred(F.col(z)).alias("_c"), F.col(y).alias("_y")).persist()  # each pass reads these rows; lost ones are made again
    bounds = {r[0]: (low, high) for r in df.select(key).distinct().collect()}
    best: dict = {}
    for _ in range(rounds):
        grid = {k: np.linspace(a, b, points) for k, (a, b) in bounds.items()}
        made = spark.createDataFrame([(k, np.exp(g).tolist()) for k, g in grid.items()], f"_k {given}, _t array<double>")
        joined = df.join(F.broadcast(made), df[key].eqNullSafe(made["_k"]))  # a row for each group
        losses = [F.avg(A.nll_at(F.col("_c"), F.col("_y"), F.col("_t")[i])).alias(f"l{i}") for i in range(points)]
        for r in joined.groupBy("_k").agg(*losses).collect():
            values = np.array([r[f"l{i}"] for i in range(points)])
            i, g = int(values.argmin()), grid[r["_k"]]
            best[r["_k"]] = (float(np.exp(g[i])), float(values[i]))
            bounds[r["_k"]] = (g[max(0, i - 1)], g[min(points - 1, i + 1)])
    df.unpersist()
    return spark.createDataFrame([(k, *v) for k, v in best.items()], f"{key} {given}, temperature double, nll double")


def grid_temperature(df: DataFrame, key: str, z: str, y: str, log_t: list[float]) -> DataFrame:
    """key, log_t, temperature, nll: the first of the given log temperatures with the least NLL per group, in one pass."""
    rows = df.select(key, A.centred(F.col(z)).alias("_c"), F.col(y).alias("_y"))
    tried = [F.struct(F.round(F.avg(A.nll_at(F.col("_c"), F.col("_y"), float(np.exp(g)))), 9).alias("nll"), F.lit(g).alias("log_t")) for g in log_t]
    best = rows.groupBy(key).agg(F.array_min(F.array(*tried)).alias("_b"))
    return best.select(key, F.col("_b.log_t").alias("log_t"), F.exp("_b.log_t").alias("temperature"), F.col("_b.nll").alias("nll"))


def fit_matrix(df: DataFrame, features: str, y: str, l2: float = 0.05):
    """Multinomial logistic regression on standardized features; l2 penalizes the weights' squares, not the intercepts."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.col(features)).alias("features"), F.col(y).cast("double").alias("label"))
    return LogisticRegression(family="multinomial", regParam=2 * l2, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(rows)


def standardize(df: DataFrame, unit: list[str], z: str, out: str = "x") -> DataFrame:
    """Label-free: each position of the logits by the mean and population deviation of its pool."""
    flat = df.select(*unit, F.posexplode(z).alias("_i", "_v"))
    stats = flat.groupBy(*unit, "_i").agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_s"))
    per = stats.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct("_i", "_m", "_s"))).alias("_pool"))
    return df.join(per, unit).withColumn(out, F.zip_with(z, "_pool", lambda v, p: (v - p["_m"]) / (p["_s"] + 1e-6))).drop("_pool")


def _minimize(loss, start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Newton-like descent with numeric derivatives and halving steps, for the few parameters of a calibration."""
    x, f = start.astype(float), loss(start)
    for _ in range(rounds):
        e = 1e-4
        n = len(x)
        g = np.array([(loss(x + e * d) - loss(x - e * d)) / (2 * e) for d in np.eye(n)])
        h = np.array([[(loss(x + e * (a + b)) - loss(x + e * (a - b)) - loss(x - e * (a - b)) + loss(x - e * (a + b))) / (4 * e * e) for b in np.eye(n)] for a in np.eye(n)])
        vals, vecs = np.linalg.eigh((h + h.T) / 2)
        step = vecs @ ((vecs.T @ g) / np.maximum(np.abs(vals), 1e-6))
        for k in range(30):
            if (trial := loss(x - step / 2**k)) < f - 1e-12:
                x, moved, f = x - step / 2**k, f - trial, trial
                break
        else:
            return x
        if moved < 1e-10:
            return x
    return x


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def vector_scaling(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(log T, bias of each level but the first)."""
    rows = np.arange(len(y))
    return _minimize(lambda p: -_log_softmax((z + np.r_[0.0, p[1:]]) / np.exp(p[0]))[rows, y].mean(), np.zeros(z.shape[1]))


#: Candidate fits in the order in which equals are preferred.
KINDS = ("raw", "T", "bias+T", "matrix")


def matrix_probabilities(z, params, k: int, features: int | None = None):
    """softmax(W (z - mean) / std + b), from flat W (k rows), b, means and deviations."""
    f = features or k
    at = lambda start, n: F.slice(params, start + 1, n)
    w = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.slice(params, i * f + 1, f))
    x = F.zip_with(F.zip_with(z, at(k * f + k, f), lambda a, b: a - b), at(k * f + k + f, f), lambda a, b: a / b)
    return A.softmax(A.let(x, lambda v: F.zip_with(F.transform(w, lambda row: A.dot(row, v)), at(k * f, k), lambda a, b: a + b)))


def candidate_probabilities(z, params, k: int) -> dict:
    """The probabilities (columns) of a level readout z under each candidate, from log T; log T and biases; the matrix."""
    level = lambda start: F.exp(F.get(params, F.lit(start)))
    bias = F.concat(F.array(F.lit(0.0)), F.slice(params, 3, k - 1))
    return {"raw": A.softmax(z), "T": A.softmax(z, level(0)), "bias+T": A.softmax(F.zip_with(z, bias, lambda a, b: a + b), level(1)), "matrix": matrix_probabilities(z, F.slice(params, k + 2, 1000), k)}


def fit_by_numpy(df: DataFrame, key: str, tie: str, cols: list[str], fit) -> DataFrame:
    """key, params: fit(*columns as arrays) of each group in one task, for groups that are small by definition (draws of a size).

    newton fits groups of any size.
    """

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(tie)
        args = [np.stack(pdf[c].to_numpy()) if pdf[c].dtype == object else pdf[c].to_numpy() for c in cols]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "params": [fit(*args).tolist()]})

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are few and fits cost time: spread the groups
    return df.select(key, tie, *cols).repartition(parts, key).groupBy(key).applyInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, params array<double>")
