"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, floor(scale * x), and are grouped by length: one bucket holds norms within a factor STEP. A
bucket is dealt into blocks of bounded size, the queries into blocks too, and each pair of blocks is one task. The
longest vectors of each dimension (whole buckets, WARM candidates or more) are searched first: the k-th best score found
there is each query's bound for the rest, and buckets too short to reach it are not visited by that query at all. A task
walks its candidates by falling length. A query's k-th best score so far, divided by its own norm and the longest norm
left, is the local cosine that a candidate must reach: above 1 the walk ends for that query; from COORD_FROM on, the
query's largest coordinates bound the candidate's (coordinate pruning); below, the lengths alone prune. What is left
is verified by exact integer products. A last step keeps the k best over all tasks.

Rows with a null id, or a vector that is null, empty or holds a null or non-finite component, take no part. Vectors are
compared with vectors of the same dimension. Ties go to the smaller id. Repeated rows are candidates each by itself; a
query's own id is never its candidate, in any copy; an id with several vectors asks with each and ranks over all. An
empty table gives an empty result. Components must keep scores within 64 bits.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.llm._common import cut, slices, small_batches, table

STEP, COORD_FROM, FOCUS = 1.05, 0.8, 4
CANDIDATES, QUERIES_PER_BLOCK, WALK, WARM = 16384, 4096, 1024, 16384
_OUT = "query_id long, vec_id long, score long"


def _integers(rows: DataFrame, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, vecs, norms, dims = [], [], [], []
            for i, v, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i is None or not v or None in v or not np.isfinite(x := np.array(v, np.float64)).all():
                    continue
                x = np.floor(scale * x)
                keep.append((i, q))
                vecs.append(x.astype("<i8").tobytes())
                norms.append(float(np.sqrt((x * x).sum())))
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.int64()), pa.array([k[1] for k in keep], pa.bool_()), pa.array(vecs, pa.binary()), pa.array(norms, pa.float64()), pa.array(dims, pa.int32())], names=["vec_id", "asks", "vec", "norm", "dim"])

    return rows.mapInArrow(run, "vec_id long, asks boolean, vec binary, norm double, dim int")


class _Best:
    """The k best candidates of each query so far."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.found, self.bound = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(floors), floors.astype(np.float64)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.found[q][0], ids]), np.concatenate([self.found[q][1], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[q] = ids[order], scores[order]
        if len(order) == self.k:
            self.bound[q] = max(self.bound[q], scores[order[-1]])


def search(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vecs: np.ndarray, k: int, floors: np.ndarray | None = None) -> _Best:
    """The k best rows of vecs (int64) for each row of queries; scores below a query's floor may be left out."""
    best = _Best(np.full(len(queries), -np.inf) if floors is None else floors, k)
    q_norm, norm = (np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) for x in (queries, vecs))
    order = np.lexsort((ids, -norm))
    ids, vecs, norm = ids[order], vecs[order], norm[order]
    exact = float(q_norm.max()) * float(norm[0]) < 2**52  # then products of doubles are whole
    left, right = (queries.astype(np.float64), vecs.astype(np.float64)) if exact else (queries, vecs)
    focus = np.argsort(-np.abs(left), axis=1, kind="stable")[:, :FOCUS]
    for at in range(0, len(ids), WALK):
        part, longest = slice(at, at + WALK), norm[at]
        reach = q_norm * longest
        live = np.flatnonzero(reach * (1 + 1e-9) + 1e-9 >= best.bound)
        if not len(live):
            break
        cosine = np.where(reach[live] > 0, best.bound[live] / np.maximum(reach[live], 1e-300), -np.inf)
        by_coord = cosine >= COORD_FROM
        dense = live[~by_coord]
        if len(dense):
            scores = left[dense] @ right[part].T
            hit = scores >= best.bound[dense][:, None]
            hit &= ids[part][None, :] != q_ids[dense][:, None]
            for r in np.flatnonzero(hit.any(axis=1)):
                best.add(dense[r], ids[part][hit[r]], scores[r][hit[r]].astype(np.int64))
        if by_coord.any():
            unit = right[part] / np.maximum(norm[part], 1e-300)[:, None]
            for q, t in zip(live[by_coord], np.minimum(cosine[by_coord], 1.0), strict=True):
                c = np.clip(left[q][focus[q]] / q_norm[q], -1, 1)
                spread, a = np.arccos(t), np.arccos(c)
                low, high = np.cos(np.minimum(a + spread, np.pi)) - 1e-7, np.cos(np.maximum(a - spread, 0)) + 1e-7
                x = unit[:, focus[q]]
                stay = np.flatnonzero(((x >= low) & (x <= high)).all(axis=1) & (ids[part] != q_ids[q]))
                if len(stay):
                    best.add(q, ids[part][stay], (right[part][stay] @ left[q]).astype(np.int64))
    return best


def _tasks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    rows = (r for batch in slices(batches, "vec") for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, group in groupby(rows, key=lambda r: r[0]):
        sides = [[], []]
        for _, asks, i, vec, floor in group:
            sides[asks].append((i, vec, floor))
        if not sides[0] or not sides[1]:
            continue
        (ids, vecs), (q_ids, queries) = ((np.array([r[0] for r in s], np.int64), np.frombuffer(b"".join(r[1] for r in s), "<i8").reshape(len(s), -1)) for s in sides)
        floors = np.array([-np.inf if r[2] is None else r[2] for r in sides[1]])
        best = search(q_ids, queries, ids, vecs, k, floors)
        n = [len(f[0]) for f in best.found]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([f[0] for f in best.found])), pa.array(np.concatenate([f[1] for f in best.found]))], names=["query_id", "vec_id", "score"])


def _searched(plan: DataFrame, queries: DataFrame, buckets: str, k: int) -> DataFrame:
    """query_id, vec_id, score: the best of each task of the buckets that an array column names, by queries with a floor."""
    h = F.xxhash64("vec_id", "vec")
    key = lambda q, bucket, b: F.concat_ws("-", F.col("dim"), q, bucket, b)
    own = F.get(F.filter(buckets, lambda x: x["bucket"] == F.col("bucket")), F.lit(0))["b"]
    tasks = F.transform(F.sequence(F.lit(0), F.col("q_blocks") - 1), lambda q: key(q, F.col("bucket"), F.pmod(h, own)))
    candidates = plan.filter((F.col("q_blocks") > 0) & own.isNotNull()).select(F.explode(tasks).alias("task"), F.lit(False).alias("asks"), "vec_id", "vec", F.lit(None).cast("long").alias("floor"))
    near = F.filter(buckets, lambda x: F.col("floor").isNull() | (x["longest"] * F.col("norm") * (1 + 1e-9) + 1e-9 >= F.col("floor")))
    wanted = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0), x["b"] - 1), lambda b: key(F.pmod(h, F.col("q_blocks")), x["bucket"], b))))
    asked = queries.select(F.explode(wanted).alias("task"), F.lit(True).alias("asks"), "vec_id", "vec", "floor")
    n = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = candidates.unionByName(asked).repartition(n, "task").sortWithinPartitions("task")
    return dealt.mapInArrow(lambda batches: _tasks(batches, k), _OUT)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(rows: DataFrame, asks: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates for every row for which asks holds."""
    small_batches(rows)
    made = cut(_integers(rows.select(F.col(vec_id).cast("long"), vec, F.coalesce(asks, F.lit(False))), scale).withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log(F.col("norm")) / np.log(STEP))).otherwise(-1)))
    sizes = made.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max("norm").alias("longest"))  # as many rows as lengths and dimensions
    above = F.coalesce(F.sum("n").over(Window.partitionBy("dim").orderBy(F.desc("longest")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bucket = F.struct("bucket", F.ceil(F.col("n") / CANDIDATES).cast("int").alias("b"), "longest")
    found = sizes.withColumn("warm", above < WARM).groupBy("dim").agg(F.collect_list(F.when(F.col("warm"), bucket)).alias("warm"), F.collect_list(F.when(~F.col("warm"), bucket)).alias("rest"), F.ceil(F.sum("q") / QUERIES_PER_BLOCK).cast("int").alias("q_blocks"))
    plan = made.join(found, "dim")
    queries = plan.filter("asks").dropDuplicates(["vec_id", "vec"])
    first = cut(_searched(plan, queries.withColumn("floor", F.lit(None).cast("long")), "warm", k))
    # an id with several vectors has one ranking, hence one floor
    floors = _ranked(first, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = _searched(plan, queries.join(floors, "vec_id", "left"), "rest", k)
    return _ranked(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op10_exact_top_k": op10_exact_top_k}
ORACLES = {
    "op10_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
}
