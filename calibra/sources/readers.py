"""Sources: JSON lines, CSV and folder labels, image folders, keyed calibrations, replayed API pages."""
from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = ("jpg", "jpeg", "png", "webp")
MAX_IMAGE_BYTES = 20 * 1024 * 1024


def jsonl(spark: SparkSession, path: str, schema: str, must_exist: bool = False) -> DataFrame:
    """JSON lines, gzip by suffix, under a fixed schema; a missing path is an empty table unless it must exist."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if must_exist or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def csv(spark: SparkSession, path: str, schema: str = "image string, level int") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def score_names(rows: DataFrame, name: str = "dist_img") -> DataFrame:
    """I01_03_05.png -> ref I01, distortion 3, level 4."""
    parts = F.split(F.regexp_replace(name, r"\.png$", ""), "_")
    return rows.withColumn("ref", parts[0]).withColumn("distortion", parts[1].cast("int")).withColumn("level", parts[2].cast("int") - 1)


def level_folders(spark: SparkSession, path: str) -> DataFrame:
    """path, level, sha256 of images in folders whose names start with their level; another name is an error."""
    level = F.regexp_extract("path", r"/(\d+)[^/]*/[^/]+$", 1)
    checked = F.when(level == "", F.raise_error(F.concat(F.lit("folder without a level: "), "path"))).otherwise(level.cast("int"))
    return images(spark, path).withColumn("level", checked)


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every image below a folder, level -1; images over the size limit are an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kept = files.filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*SUFFIXES))
    size = F.when(F.col("length") > MAX_IMAGE_BYTES, F.raise_error(F.concat(F.lit("image too large: "), "path"))).otherwise(F.col("length"))
    return kept.select("path", size.alias("bytes"), F.sha2("content", 256).alias("sha256"), F.lit(-1).alias("level"))


def verified(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A downloaded file's row; a wrong checksum is an error."""
    got = spark.read.format("binaryFile").load(path).withColumn("sha256", F.sha2("content", 256))
    return got.withColumn("length", F.when(F.col("sha256") == sha256, F.col("length")).otherwise(F.raise_error(F.lit("checksum differs"))))


def run_ids(spark: SparkSession, path: str) -> DataFrame:
    """Run ids named in text logs."""
    found = F.regexp_extract("value", r"run (\d{8}T\d{6}Z-[0-9a-f]+)", 1)
    return spark.read.text(path).select(found.alias("run_id")).filter("run_id <> ''").distinct()


def first_by_priority(tables: list[DataFrame], key: str) -> DataFrame:
    """A row for each key, from the first table that has it."""
    ranked = [t.withColumn("_o", F.lit(i)) for i, t in enumerate(tables)]
    union = ranked[0]
    for t in ranked[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_o")
    return union.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_o", "_r")


def required(found: DataFrame, value: str, wanted: str = "calibrated") -> DataFrame:
    """An error on rows that ask for a calibration and have none."""
    bad = F.col(wanted) & F.col(value).isNull()
    return found.withColumn(value, F.when(bad, F.raise_error(F.lit("no calibration for this key"))).otherwise(F.col(value)))


def replayed_pages(spark: SparkSession, path: str, schema: str, per_class: int, kind: str = "kind", pos: str = "pos") -> DataFrame:
    """Saved API pages, up to a quota for each class in page order. The live API needs a network and is not built."""
    rows = jsonl(spark, path, schema)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(kind).orderBy(pos))).filter(F.col("_r") <= per_class).drop("_r")


def footer_values(spark: SparkSession, path: str) -> dict[str, str]:
    """The key-value metadata of a Parquet file's footer, read through the file's own store."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    if fs.getFileStatus(where).isDirectory():
        where = next(s.getPath() for s in fs.listStatus(where) if s.getPath().getName().endswith(".parquet"))
    file = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, conf))
    try:
        return dict(file.getFooter().getFileMetaData().getKeyValueMetaData())
    finally:
        file.close()


def label_names(spark: SparkSession, path: str, column: str = "label") -> DataFrame:
    """label, name: the class names that a dataset's footer holds under `huggingface`; an error without them."""
    found = json.loads(footer_values(spark, path).get("huggingface", "{}"))
    names = found.get("info", {}).get("features", {}).get(column, {}).get("names")
    if not names:
        raise ValueError(f"no class names of {column} in the footer of {path}")
    return spark.createDataFrame(list(enumerate(names)), "label int, name string")


def hidden_states(spark: SparkSession, path: str) -> DataFrame:
    """source, item_id, hidden array<float> of NPZ files with item_ids and a matrix of half floats called hidden."""

    def run(batches):
        for batch in batches:
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    ids, rows = z["item_ids"].astype(str), z["hidden"].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(ids)), pa.array(ids.tolist(), pa.string()), pa.array(list(rows), pa.list_(pa.float32()))], names=["source", "item_id", "hidden"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "source string, item_id string, hidden array<float>")


def config_patch(text: str, name: str) -> dict:
    """A settings file as a dictionary: JSON, or YAML where its library is there."""
    if name.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)
