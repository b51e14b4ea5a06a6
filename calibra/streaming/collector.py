"""A resumable collector: every item of a growing folder is read out by several methods, each once."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The readouts that every item gets (fixed values).
METHODS = ("independent", "cumulative", "digits", "anchors_cumulative", "anchors_digits")
ANCHORS = ("0:123",)
KEYS = ["ladder", "item_id", "method_key"]
#: Methods that a mask holds.
BITS = 62


def method_key(method: str, variant: str | None) -> str:
    return method if variant is None else f"{method}@{variant}"


def work(items: DataFrame, methods: list[tuple[str, str | None]]) -> DataFrame:
    """items by method: (method, variant) pairs; the key of a variant is method@variant."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.lit(v).cast("string").alias("variant"), F.lit(method_key(m, v)).alias("method_key")) for m, v in methods)))
    return items.select("*", each.alias("_m")).select("*", "_m.*").drop("_m")


def jobs(methods: tuple[str, ...] = METHODS, zooms: tuple[str, ...] = (), anchors: tuple[str, ...] = ANCHORS) -> list[tuple[str, str | None]]:
    """Plain readouts, then zoomed ones at further positions, then those with each set of anchors."""
    plain = [(m, None) for m in methods if not m.startswith("anchors_")]
    return plain + [(m, f"pos:{p}") for p in zooms if p != "c" for m in methods if m.startswith("zoom_")] + [(m, a) for a in anchors for m in methods if m.startswith("anchors_")]


def collect(spark: SparkSession, source: str, schema: str, target: str, state: str, readout: Callable[[DataFrame], DataFrame], methods: list[tuple[str, str | None]] | None = None, files: int = 1) -> None:
    """Reads out all items that are in source now and stops; what target already has is not asked again.

    source: a folder of Parquet files with ladder, item_id and what readout needs. readout takes the rows of `work` and adds
    its results. The checkpoint in state leads a restart on to the files that are not done; a batch that was cut off comes
    again, and the rows it had already written are left out by their keys, so nothing is there twice.
    """
    every = methods or jobs()

    def batch(items: DataFrame, _: int) -> None:
        step(spark, items, target, readout, every)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def step(spark: SparkSession, items: DataFrame, target: str, readout: Callable[[DataFrame], DataFrame], methods: list[tuple[str, str | None]]) -> None:
    """One batch: what target has is taken out before it is read out.

    Items and rows of target meet in one aggregation by item, in which a row of target is a bit in its item's mask: tasks
    start it before the shuffle, and one narrow row goes through it for each item instead of one for each method. What
    readout gives twice is written once, without a shuffle where readout leaves its rows in place, as new columns do.
    """
    item, keys = KEYS[:2], [method_key(*m) for m in methods]
    more = [c for c in items.columns if c not in item]
    bits = {k: (f"_done{i // BITS}", 1 << i % BITS) for i, k in enumerate(keys)}
    full = {mask: sum({b for m, b in bits.values() if m == mask}) for mask, _ in bits.values()}
    rows = items.select(*item, F.lit(True).alias("_new"), *(F.lit(0).cast("long").alias(mask) for mask in full), *more)
    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        of = lambda mask: F.coalesce(*(F.when(F.col("method_key") == k, F.lit(b)) for k, (m, b) in bits.items() if m == mask), F.lit(0)).cast("long")
        rows = rows.unionByName(spark.read.parquet(target).select(*item, F.lit(False).alias("_new"), *(of(mask).alias(mask) for mask in full)), allowMissingColumns=True)
    values = [F.first(F.when(F.col("_new"), F.struct(*more)), ignorenulls=True).alias("_more")] if more else []
    met = rows.groupBy(*item).agg(F.max("_new").alias("_new"), *(F.bit_or(mask).alias(mask) for mask in full), *values)
    some = F.lit(False)
    for mask, b in full.items():
        some |= F.col(mask) != b
    met = met.filter(F.col("_new") & some).select(*(c if c in item else F.col("_more").getField(c).alias(c) for c in items.columns), *full)
    done = F.lit(False)
    for k, (mask, b) in bits.items():
        done |= (F.col("method_key") == k) & (F.col(mask).bitwiseAND(F.lit(b)) != 0)
    todo = work(met, methods).filter(~done).drop(*full)
    readout(todo).dropDuplicates(KEYS).write.mode("append").parquet(target)
