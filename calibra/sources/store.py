"""A keyed table in buckets: an upsert rewrites only the buckets that its keys fall into, and readers see all of it or nothing.

    root/data/<write>/_bucket=<b>/    files of one write; never changed afterwards
    root/manifest/<version>.json      which write holds each bucket, from that version on

A version appears by renaming its finished manifest, which fails if another writer took the number (where a store's rename
replaces files, let one writer work at a time). Readers take the greatest version, or an older one by number; what an unfinished write leaves is in no manifest.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.sources.scratch import delete

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer committed first: read again and repeat."""


class KeyedStore:
    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = BUCKETS) -> None:
        """buckets counts when the table is made; later the manifest's own number holds."""
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        state = self._state(self.version())
        self.buckets = state["buckets"] if state else buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("manifest").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The greatest committed version; 0 before the first."""
        fs, folder = self._fs(), self._path("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _state(self, version: int) -> dict | None:
        if version == 0:
            return None
        stream = self._fs().open(self._path(f"manifest/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, state: dict) -> None:
        fs, draft = self._fs(), self._path(f"manifest/draft-{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(json.dumps(state).encode())
        stream.close()
        target = self._path(f"manifest/{version}.json")
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.root} is taken")

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The table at a version, the greatest by default; only some buckets if given."""
        version = self.version() if version is None else version
        state = self._state(version)
        if state is None:
            raise FileNotFoundError(f"{self.root} has no version yet")
        paths = [f"{self.root}/{where}" for b, where in state["where"].items() if buckets is None or int(b) in buckets]
        schema = self.spark.createDataFrame([], state["schema"]).schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, new: DataFrame) -> int:
        """Commits new over the rows with the same keys; the new version. Of new rows that share keys any one stays.

        Nulls in keys are keys like others. Columns must be those of the table.
        """
        version = self.version()
        state = self._state(version)
        columns = [f for f in new.schema.fields]
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
        if state and state["schema"] != ddl:
            raise ValueError(f"the table has {state['schema']}, not {ddl}")
        rows = new.dropDuplicates(self.keys)
        touched = {r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()}  # as many as buckets at most
        if state:
            old = self.read(version, touched)
            same = None
            for k in self.keys:
                one = old[k].eqNullSafe(F.col(f"_new_{k}"))
                same = one if same is None else same & one
            kept = old.join(rows.select(*(F.col(k).alias(f"_new_{k}") for k in self.keys)), same, "left_anti")
            rows = kept.unionByName(rows)
        write = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{write}")
        where = {**(state["where"] if state else {}), **{str(b): f"{write}/_bucket={b}" for b in touched}}
        self._commit(version + 1, {"buckets": self.buckets, "keys": self.keys, "schema": ddl, "where": where})
        return version + 1

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all but the last `keep` versions, and the bucket files that none of those names. No write may be under way."""
        fs, last = self._fs(), self.version()
        used = {w for v in range(max(1, last - keep + 1), last + 1) for w in self._state(v)["where"].values()}
        for v in range(1, last - keep + 1):
            fs.delete(self._path(f"manifest/{v}.json"), False)
        for write in fs.listStatus(self._path("data")):
            name = f"data/{write.getPath().getName()}"
            inside = [f"{name}/{s.getPath().getName()}" for s in fs.listStatus(write.getPath()) if s.isDirectory()]
            for gone in [w for w in inside if w not in used] if used & set(inside) else [name]:
                delete(self.spark, f"{self.root}/{gone}")
