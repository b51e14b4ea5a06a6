"""Sinks: appended JSON lines, day-partitioned logs, keyed overwrite, verified manifests, upserts."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def daily_log(calls: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """Calls by UTC day, failures and successes alike."""
    calls.withColumn("day", F.to_date(ts)).write.mode(mode).partitionBy("day").parquet(path)


def save_keyed(df: DataFrame, path: str, key: str = "key_hash") -> None:
    """Replaces the keys that df holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def extend_manifest(new: DataFrame, committed: DataFrame, cols: list[str], pos: str = "pos") -> DataFrame:
    """The rows to append; an error if a committed row differs from the new row at its place."""
    was = committed.select(pos, F.struct(*cols).alias("_was"))
    both = new.join(was, pos, "left")
    bad = F.col("_was").isNotNull() & (F.struct(*cols) != F.col("_was"))
    checked = both.withColumn("_ok", F.when(bad, F.raise_error(F.concat(F.lit("manifest differs at "), F.col(pos).cast("string")))).otherwise(F.col("_was").isNull()))
    return checked.filter("_ok").drop("_was", "_ok")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows over old ones by key."""
    both = old.withColumn("_o", F.lit(1)).unionByName(new.withColumn("_o", F.lit(0)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_o"))).filter("_r = 1").drop("_o", "_r")


def run_directory(path: str, tables: dict[str, DataFrame], config: dict) -> None:
    """The tables of a run, each in its folder under one path that must be new, and its configuration; predictions as gzipped JSON lines."""
    for name, df in tables.items():
        if name in ("predictions", "errors"):
            df.write.option("compression", "gzip").json(f"{path}/{name}")
        else:
            df.write.parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/config")


def snapshot(lines: DataFrame, path: str, root: str, column: str = "value") -> None:
    """Text with its absolute root taken out, gzipped."""
    lines.select(F.replace(F.col(column), F.lit(root), F.lit("")).alias("value")).write.option("compression", "gzip").text(path)
