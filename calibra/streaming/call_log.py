"""The call log as a stream: new files are read once, duplicates dropped, and day counts kept by a file checkpoint."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_counts(spark: SparkSession, source: str, work: str, late: str = "1 day") -> DataFrame:
    """day, event_type, calls, total_ms of all files now in source, through a stream that stops when it has caught up.

    A call that comes again within `late` of the first is dropped; one that comes later counts anew (`append_once` takes
    none twice, at the price of a look at what is there).
    """
    schema = spark.read.parquet(source).schema
    folder, _, name = source.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, source) else spark.readStream.schema(schema).parquet(source)
    once = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    out = f"{work}/{uuid.uuid4().hex}"
    q = once.select(F.to_date("ts").alias("day"), "event_type", "value").writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("day", "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("total_ms"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def append_once(spark: SparkSession, batch: DataFrame, target: str, keys: list[str]) -> None:
    """For foreachBatch: appends the rows whose keys are not yet in target, so a repeated batch adds nothing."""
    batch = batch.dropDuplicates(keys)
    if spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(target)):
        batch = batch.join(spark.read.schema(batch.schema).parquet(target).select(*keys), keys, "left_anti")
    batch.write.mode("append").parquet(target)
