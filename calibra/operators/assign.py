"""Assignment of sources to levels, each source used once, the level with the fewest candidates first.

All units (scales) go together. The scarcest level of each takes its first candidates in the order of the sources; what it
takes is gone for the next. A round's rows are cut to the wanted number before they are shuffled, and what is used joins as
a table of as many rows as were wanted, so no level and no unit is gathered.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.sources.scratch import cut


def scarcity(candidates: DataFrame, unit: str, levels: int) -> DataFrame:
    """unit, level, found, turn: how many sources could have a level, and when it chooses (from 0; ties by level)."""
    every = candidates.select(unit).distinct().select(unit, F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    found = candidates.groupBy(F.col(unit).alias("_u"), F.col("level").alias("_l")).agg(F.count("*").alias("_n"))
    counted = every.join(found, F.col(unit).eqNullSafe(F.col("_u")) & (F.col("level") == F.col("_l")), "left").select(unit, "level", F.coalesce("_n", F.lit(0)).alias("found"))
    return counted.withColumn("turn", F.row_number().over(Window.partitionBy(unit).orderBy("found", "level")) - 1)  # a row for each level


def assign(candidates: DataFrame, unit: str, source: str, order: Column, levels: int, needed: int) -> tuple[DataFrame, DataFrame]:
    """(unit, level, source, place; shortfalls: unit, level, needed, got).

    candidates: unit, source, level (0 to levels - 1) of every level that a source could have; repeated rows count once.
    place is the source's number within its level, from 0. Rows without a source or level are left out.
    """
    rows = cut(candidates.filter(F.col(source).isNotNull() & F.col("level").between(0, levels - 1)).select(unit, source, "level", order.alias("_order")).dropDuplicates([unit, source, "level"]))
    turns = cut(scarcity(rows, unit, levels))
    same = F.col(unit).eqNullSafe(F.col("_u"))
    taken = None
    for turn in range(levels):
        chooses = turns.filter(F.col("turn") == turn).select(F.col(unit).alias("_u"), F.col("level").alias("_l"))
        able = rows.join(chooses, same & (F.col("level") == F.col("_l")), "left_semi")
        if taken is not None:
            used = taken.select(F.col(unit).alias("_u"), F.col(source).alias("_s"))
            able = able.join(used, same & (F.col(source) == F.col("_s")), "left_anti")
        place = F.row_number().over(Window.partitionBy(unit).orderBy("_order", source))
        new = able.withColumn("place", place).filter(F.col("place") <= needed).select(unit, "level", source, (F.col("place") - 1).alias("place"))
        taken = cut(new if taken is None else taken.unionByName(new))
    got = taken.groupBy(F.col(unit).alias("_u"), F.col("level").alias("_l")).agg(F.count("*").alias("_n"))
    short = turns.join(got, same & (F.col("level") == F.col("_l")), "left").select(unit, "level", F.lit(needed).alias("needed"), F.coalesce("_n", F.lit(0)).alias("got"))
    return taken, short.filter(F.col("got") < needed)


def demand(shortfalls: DataFrame) -> None:
    """An error that names every level that could not be filled, of all units."""
    rows = shortfalls.orderBy(*shortfalls.columns[:2]).collect()  # a row for each unit and level at most
    if rows:
        raise ValueError("too few sources: " + "; ".join(f"{r[0]} level {r['level']}: {r['got']} of {r['needed']}" for r in rows))
