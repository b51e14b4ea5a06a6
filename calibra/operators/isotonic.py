"""Monotone regression of many groups: pooled neighbours within ranges of the order, then across them.

Equal x are one value with a sum and a count. Ranges of the order are pooled apart, into blocks of values whose means rise;
the blocks of a group, which are the steps of its model, are then pooled in one task. Pooling blocks gives what pooling
their rows would, so the ranges change nothing.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.operators.ranks import level_of, quantile_cuts
from calibra.sources.scratch import cut

#: Groups with fewer rows have no model.
MIN_ROWS = 1000


def pooled(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First index of each block, of values with sums s and counts n in order: neighbours that do not rise are one."""
    first, sums, counts = [], [], []
    for i in range(len(s)):
        at, a, b = i, float(s[i]), float(n[i])
        while first and sums[-1] * b >= a * counts[-1]:
            at, a, b = first.pop(), a + sums.pop(), b + counts.pop()
        first.append(at)
        sums.append(a)
        counts.append(b)
    return np.array(first, np.int64)


def fit(df: DataFrame, unit: str, x: str, y: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """unit, n, xs, ys of each unit with min_rows rows or more: rising xs with ys that do not fall, the ends of each block.

    Between xs values are interpolated, beyond them they stay (arrays.interpolate). Rows with a null or NaN x or y are left out.
    """
    kind = df.schema[unit].dataType.simpleString()
    rows = df.select(F.col(unit).alias("u"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    values = cut(rows.groupBy("u", "x").agg(F.sum("y").alias("s"), F.count("*").alias("n")))
    whole = values.groupBy(F.col("u").alias("_u")).agg(F.sum("n").alias("rows")).filter(F.col("rows") >= min_rows)
    enough = values.join(whole, F.col("u").eqNullSafe(F.col("_u")), "left_semi")
    cuts = sorted(set(quantile_cuts(values, F.col("x"), 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))

    def blocks(pdf):
        import pandas as pd

        pdf = pdf.sort_values("lo")
        first = pooled(pdf["s"].to_numpy(), pdf["n"].to_numpy())
        last = np.r_[first[1:], len(pdf)] - 1
        add = lambda c: np.add.reduceat(pdf[c].to_numpy(), first)
        return pd.DataFrame({"u": [pdf["u"].iloc[0]] * len(first), "lo": pdf["lo"].to_numpy()[first], "hi": pdf["hi"].to_numpy()[last], "s": add("s"), "n": add("n")})

    schema = f"u {kind}, lo double, hi double, s double, n long"
    ranged = enough.select("u", F.col("x").alias("lo"), F.col("x").alias("hi"), "s", "n", level_of(cuts, F.col("x")).alias("place"))
    merged = ranged.groupBy("u", "place").applyInPandas(blocks, schema).groupBy("u").applyInPandas(blocks, schema)
    ends = F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi"))
    steps = merged.select("u", "n", "lo", F.transform(ends, lambda e: F.struct(e.alias("x"), (F.col("s") / F.col("n")).alias("y"))).alias("ends"))
    model = steps.groupBy("u").agg(F.sum("n").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lo", "ends"))), lambda b: b["ends"])).alias("ends"))
    return model.select(F.col("u").alias(unit), "n", F.col("ends.x").alias("xs"), F.col("ends.y").alias("ys"))
