"""Ranks and running sums within groups of any size.

A window over a whole group sorts it in one task. Here quantiles of the order cut the table into ranges first; each
range of a group is sorted by itself, and sums over the ranges before it, one row a range and group, place it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.functions.arrays import let
from calibra.sources.scratch import FEW_ROWS, cut


def level_of(cuts: list[float], value: Column) -> Column:
    """2 * (rising cuts at or below value), less one for a value that is a cut itself; by halving steps."""
    if not cuts:
        return F.lit(0)
    array = F.array(*map(F.lit, cuts))

    def step(low: Column, size: Column) -> Column:
        return F.when((low + size <= len(cuts)) & (F.get(array, low + size - 1) <= value), low + size).otherwise(low)

    upto = F.aggregate(F.array(*(F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1))), F.lit(0), step)
    return let(upto, lambda k: 2 * k - F.when(F.get(array, k - 1) == value, 1).otherwise(0))


def quantile_cuts(df: DataFrame, value: Column, ranges: int) -> list[float]:
    found = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else None
    return found or []


def running(df: DataFrame, unit: list[str], by: str, tie: str, sums: dict[str, Column] | None = None, desc: bool = False, order: list[Column] | None = None) -> DataFrame:
    """df with _rank (from 1, within unit, by `by` and then tie), _n (rows of the unit) and the running sums _name of sums.

    `by` must be a number; nulls come first, or last if desc. Where one value of it is frequent, its rows are cut further
    by tie if that is a number. `order` may refine the order among equal values of by; tie then does not cut.

    The rows are made once and written; give only the columns that are needed. They are sorted by one shuffle, and the
    offsets of the ranges are broadcast where they are few.
    """
    ranges = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = sums or {}
    columns = df.columns
    rows = cut(df.withColumns({f"_{k}": v for k, v in sums.items()}))
    key = (-F.col(by) if desc else F.col(by)).cast("double")
    points = quantile_cuts(rows, key, ranges)
    cuts, often = sorted(set(points)), sorted({a for a, b in zip(points[:-1], points[1:], strict=True) if a == b})
    numeric = isinstance(df.schema[tie].dataType, T.NumericType) and order is None
    at = F.array_contains(F.array(*map(F.lit, often)), key) if often else F.lit(False)
    tie_cuts = sorted(set(quantile_cuts(rows.filter(at), F.col(tie).cast("double"), ranges))) if often and numeric else []
    fine = 2 * len(tie_cuts) + 1
    place = level_of(cuts, key) * fine + (F.when(at, level_of(tie_cuts, F.col(tie).cast("double"))).otherwise(0) if tie_cuts else 0)
    place = F.when(key.isNull(), (2 * len(cuts) + 1) * fine if desc else -1).otherwise(place)
    rows = rows.withColumn("_place", place)
    per = cut(rows.groupBy(*unit, "_place").agg(F.count("*").alias("_c"), *(F.sum(f"_{k}").alias(f"_s_{k}") for k in sums)))
    whole = Window.partitionBy(*unit)  # at most a row for each range
    before = whole.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = per.select(*(F.col(u).alias(f"_u{i}") for i, u in enumerate(unit)), F.col("_place").alias("_p"), F.sum("_c").over(whole).alias("_n"), earlier("_c").alias("_o"), *(earlier(f"_s_{k}").alias(f"_o_{k}") for k in sums))
    if per.count() <= FEW_ROWS:
        offsets = F.broadcast(offsets)
    within = Window.partitionBy(*unit, "_place").orderBy(F.desc(by) if desc else F.asc(by), *(order or []), tie)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumns({"_r": F.row_number().over(within)} | {f"_{k}": F.sum(f"_{k}").over(upto) for k in sums})
    same = F.col("_place") == F.col("_p")
    for i, u in enumerate(unit):
        same &= F.col(u).eqNullSafe(F.col(f"_u{i}"))
    made = {"_rank": F.col("_o") + F.col("_r")} | {f"_{k}": F.col(f"_o_{k}") + F.col(f"_{k}") for k in sums}
    return ranked.join(offsets, same).select(*columns, "_n", *(v.alias(k) for k, v in made.items()))
