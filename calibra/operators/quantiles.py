"""Exact quantiles by narrowing: no task holds, sorts or counts the distinct values of a group.

Each round cuts the range in which a wanted rank lies into equal buckets, counts the rows of each bucket with its least
and greatest value, and goes on within the bucket that holds the rank, until that holds one value only. A bucket's ends are values that
occur, so every round at least parts the least from the greatest.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.sources.scratch import FEW_ROWS, cut

#: Buckets of a range in each round.
BUCKETS = 4096


def quantiles(df: DataFrame, unit: list[str], value: str, shares: list[float]) -> DataFrame:
    """unit, n, lo, hi, q (an array with a value for each share, interpolated between neighbours) of each unit.

    Null and NaN values are left out; units without others are absent. Units may be null. An infinite value counts as the
    greatest or least finite double.
    """
    most = F.lit(1.7976931348623157e308)
    rows = df.select(*unit, F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    rows = cut(rows.withColumn("_v", F.greatest(-most, F.least(most, "_v"))))
    whole = cut(rows.groupBy(*unit).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    place = lambda s: (F.col("n") - 1) * F.lit(float(s))
    wanted = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(s)) + 1, F.ceil(place(s)) + 1) for s in shares))))
    # a rank and the range that holds it, less the rows before the range
    open_ = cut(whole.select(*unit, F.explode(wanted).alias("rank"), F.lit(0).cast("long").alias("before"), "lo", "hi"))
    done = open_.filter("lo = hi").select(*unit, "rank", F.col("lo").alias("v"))
    open_ = open_.filter("lo < hi")
    while not open_.isEmpty():
        narrower = cut(_narrow(rows, open_, unit))
        done = done.unionByName(narrower.filter("lo = hi").select(*unit, "rank", F.col("lo").alias("v")))
        open_ = narrower.filter("lo < hi")
    same = lambda d: [F.col(u).eqNullSafe(d[f"_{u}"]) for u in unit]
    ranks = done.groupBy(*(F.col(u).alias(f"_{u}") for u in unit)).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_at"))  # two ranks for each share
    joined = whole.join(ranks, _all(same(ranks)))

    def at(s: float):
        low, high = F.element_at("_at", F.floor(place(s)) + 1), F.element_at("_at", F.ceil(place(s)) + 1)
        return low + (high - low) * (place(s) - F.floor(place(s)))

    return joined.select(*unit, "n", "lo", "hi", F.array(*(at(s) for s in shares)).alias("q"))


def _all(conditions: list):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _narrow(rows: DataFrame, open_: DataFrame, unit: list[str]) -> DataFrame:
    """open_ with each range replaced by its bucket with the wanted rank."""
    named = {u: f"_{u}" for u in unit}
    ranges = open_.select(*(F.col(u).alias(named[u]) for u in unit), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).distinct()
    if ranges.count() <= FEW_ROWS:
        ranges = F.broadcast(ranges)
    within = rows.join(ranges, _all([F.col(u).eqNullSafe(F.col(named[u])) for u in unit] + [F.col("_v").between(F.col("_lo"), F.col("_hi"))]))
    # halves keep the width of a range finite; rounding is monotone, so buckets rise with values
    bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * BUCKETS))
    bucket = F.when(F.col("_v") == F.col("_hi"), BUCKETS).otherwise(F.coalesce(bucket, F.lit(0)))
    counts = within.groupBy(*unit, "_lo", "_hi", bucket.alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    upto = Window.partitionBy(*unit, "_lo", "_hi").orderBy("_b")  # at most BUCKETS + 1 rows
    counts = counts.withColumn("_upto", F.sum("_c").over(upto)).withColumnsRenamed(named)
    inside = F.col("rank") - F.col("before")
    found = open_.join(counts, _all([F.col(u).eqNullSafe(F.col(named[u])) for u in unit] + [F.col("lo") == F.col("_lo"), F.col("hi") == F.col("_hi"), inside <= F.col("_upto"), inside > F.col("_upto") - F.col("_c")]))
    return found.select(*unit, "rank", (F.col("before") + F.col("_upto") - F.col("_c")).alias("before"), F.col("_least").alias("lo"), F.col("_most").alias("hi"))
