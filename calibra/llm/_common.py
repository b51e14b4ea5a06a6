"""Helpers shared by the corpus operators."""
from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir; a local one only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="calibra-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there and survives lost executors.

    `drop` deletes the files once nothing reads them any more; what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_clear)
    _left[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


_left: dict[str, SparkSession] = {}


def drop(*cuts: DataFrame) -> None:
    """Deletes the files of tables that `cut` gave and that nothing reads any more."""
    for df in cuts:
        if _left.pop(df._cut, None):
            delete(df.sparkSession, df._cut)


def _clear() -> None:
    for path, spark in _left.items():
        try:
            delete(spark, path)
        except Exception:  # the session has ended: nothing can reach its store any more
            return


def small_batches(df: DataFrame) -> None:
    """Lets Spark hand Python workers batches of about BATCH_BYTES from now on: bytes bound memory, the number of rows does not."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


BATCH_BYTES = 4 << 20
#: Bytes of text that a Python worker turns into objects at once.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: int | str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `most` (SLICE_BYTES) bytes in a column of texts or bytes; a row of more is a piece of its own."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        piece = np.cumsum(size) // (most or SLICE_BYTES)
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(size)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def free_name(df: DataFrame, *names: str) -> None:
    """New columns must not hide columns of the input."""
    taken = [n for n in names if n.lower() in {c.lower() for c in df.columns}]
    if taken:
        raise ValueError(f"the input already has columns {taken}; choose other output names")


#: Bits of a membership filter: its size is fixed, whatever the number of ids; with very many ids it lets all rows pass.
FILTER_BITS = 1 << 25


def id_hash(*cols: str):
    """The hash that `members_filter` and `may_hold` share."""
    return F.xxhash64(*cols)


def members_filter(hashes: DataFrame):
    """A broadcast Bloom filter (two bits a member) over one column of hashes; at most FILTER_BITS / 64 words reach the driver."""
    h, spark = hashes.columns[0], hashes.sparkSession
    bits = F.explode(F.array(F.expr(f"{h} & {FILTER_BITS - 1}"), F.expr(f"shiftrightunsigned({h}, 25) & {FILTER_BITS - 1}"))).alias("p")
    words = hashes.select(bits).groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v")).toArrow()
    table_ = np.zeros(FILTER_BITS // 64, np.uint64)
    table_[np.asarray(words["w"], np.int64)] = np.asarray(words["v"], np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(table_)


def may_hold(words: np.ndarray, hashes) -> np.ndarray:
    """For each hash, False only if it is no member."""
    h = np.asarray(hashes, np.int64).view(np.uint64)
    out = np.ones(len(h), bool)
    for p in (h & np.uint64(FILTER_BITS - 1), (h >> np.uint64(25)) & np.uint64(FILTER_BITS - 1)):
        out &= ((words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out


def give_back() -> None:
    """Returns freed memory of a Python worker to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
