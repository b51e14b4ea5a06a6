"""Periodic runs of words: stretches that repeat with a period at least MIN_EXP times, found at every lag.

A text is an array of word ids; for each lag q up to n / MIN_EXP it is compared with itself shifted by q, and true
stretches that are long enough are runs. Lags are compared together, as the rows of one matrix for each doubling of q. A
stretch that counts has 3 * q matches or more, so from q = 8 on the matrix holds every (q0 / 4)-th position only: twelve
neighbours that match show where to compare every position, and no run can fall between them. Texts of LONG_BYTES or
more are split into document-lag ranges that Spark deals to its tasks; what their tasks find meets by document.

Nulls: a null text has no words and no runs. Rows that share an id, or repeat, are judged each by itself; each gives one
row. Empty tables give none; columns beyond doc_id and text are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm._common import give_back, slices, small_batches, table

MIN_EXP, MIN_WORDS = 4, 6
#: Texts of so many bytes are scanned by several tasks, one more for each such number of bytes.
LONG_BYTES = 1 << 16
RUN = "struct<start: long, length: long, period: long>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: (doc_id, number of words) -> (a, p): words from a on become the first p of them over and over; None: as they are.
Rewrite = Callable[[int | None, int], tuple[int, int] | None]


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def words_of(text: str | None, doc_id: int | None, rewrite: Rewrite | None) -> list[bytes]:
    words = (text or "").encode().split()  # of bytes: at \x20 and \x09 to \x0D
    change = rewrite(doc_id, len(words)) if rewrite and words else None
    if change:
        a, p = change
        words = words[:a] + (words[a : a + p] * ((len(words) - a) // p + 1))[: len(words) - a]
    return words


def _stretches(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of each stretch of consecutive numbers."""
    cuts = np.flatnonzero(np.diff(hits) != 1) + 1
    first = hits[np.concatenate(([0], cuts))]
    return first, np.diff(np.concatenate(([0], cuts, [len(hits)])))


def scan(ids: np.ndarray, low: int = 1, high: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs with lags from low to under high; one stretch may come with several periods."""
    n = len(ids)
    top = n // MIN_EXP + 1 if high is None else min(high, n // MIN_EXP + 1)
    found: list[tuple[int, int, int]] = []
    if low >= top or n < MIN_WORDS:
        return found
    padded = np.full(n + top, -1, np.int32)
    padded[:n] = ids
    q0 = low
    while q0 < top:
        q1 = min(top, 8 if q0 < 8 else 2 * q0)
        step = max(1, q0 // 4)
        width = (n + step - 1) // step
        # row r is the text shifted by q0 + r; its last position is past the end, so stretches never run on into the next row
        hits = np.flatnonzero(np.ndarray((q1 - q0, width), np.int32, padded, 4 * q0, (4, 4 * step)) == padded[:n:step])
        if len(hits):
            first, number = _stretches(hits)
            lags = q0 + first // width
            need = np.maximum(MIN_WORDS - lags, (MIN_EXP - 1) * lags)
            keep = number >= need // step
            first, number, lags, need = first[keep] % width, number[keep], lags[keep], need[keep]
            if step == 1:
                found += zip(first.tolist(), (number + lags).tolist(), lags.tolist(), strict=True)
            else:
                found += _verified(ids, first, number, lags, need, step, [r for r in found if r[1] >= MIN_EXP * q0])
        q0 = q1
    return found


def _verified(ids, first, number, lags, need, step, known):
    """The runs around stretches of the grid: they lie between the grid's mismatches on both sides."""
    found: list[tuple[int, int, int]] = []
    begin, end = np.maximum(0, (first - 1) * step + 1), np.minimum(len(ids) - lags, (first + number) * step)
    open_ = np.ones(len(lags), bool)

    def settle(run):
        # a grid stretch within a run of period p and p + q words or more has the run's smallest period: it is that run
        open_[(begin >= run[0]) & (end + lags <= run[0] + run[1]) & (run[1] >= run[2] + lags)] = False

    for run in known:
        settle(run)
    for i in range(len(lags)):
        if open_[i]:
            a, b, q = int(begin[i]), int(end[i]), int(lags[i])
            hits = np.flatnonzero(ids[a:b] == ids[a + q : b + q])
            if len(hits):
                for s, m in zip(*(x.tolist() for x in _stretches(hits)), strict=True):
                    if m >= need[i]:
                        found.append((a + s, m + q, q))
                        settle(found[-1])
    return found


def smallest(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of runs over the same words the one with the smallest period, by start, then period."""
    best: dict[tuple[int, int], int] = {}
    for s, m, q in runs:
        best[s, m] = min(q, best.get((s, m), q))
    return sorted(((s, m, q) for (s, m), q in best.items()), key=lambda r: (r[0], r[2]))


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, exactly; ties by start, then period, the order of the list."""
    top = None
    for run in runs:
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    return top


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run holds after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for s, m, q in runs:
        keep[s + q : s + m] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


_OUT = f"doc_id long, n_runs long, runs array<{RUN}>, top {RUN}, text string"


def _collapse(batches: Iterator[pa.RecordBatch], rewrite: Rewrite | None) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, text and, where the runs are found already, runs."""
    for batch in slices(batches, "text"):
        given = batch.column("runs").to_pylist() if "runs" in batch.schema.names else None
        doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        found, kept = [], []
        for i, (doc_id, text) in enumerate(zip(doc_ids, texts, strict=True)):
            words = words_of(text, doc_id, rewrite)
            runs = smallest(scan(word_ids(words)) if given is None else [(r["start"], r["length"], r["period"]) for r in given[i] or ()])
            found.append(runs)
            kept.append(collapsed(words, runs))
        flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
        struct = _RUNS.value_type
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(struct)))
        tops = pa.array([dict(zip(("start", "length", "period"), t, strict=True)) if (t := greatest(r)) else None for r in found], struct)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), lists, tops, pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_runs", "runs", "top", "text"])
    give_back()


def _ranges(batches: Iterator[pa.RecordBatch], rewrite: Rewrite | None) -> Iterator[pa.RecordBatch]:
    """key, start, length, period of the runs of rows key, doc_id, text, low, high."""
    for batch in slices(batches, "text"):
        for row in batch.to_pylist():
            runs = scan(word_ids(words_of(row["text"], row["doc_id"], rewrite)), row["low"], row["high"])
            flat = np.array(runs, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(flat), pa.string()), *(pa.array(flat[:, c]) for c in range(3))], names=["key", "start", "length", "period"])
    give_back()


def lag_ranges(size: Column, long_bytes: int) -> Column:
    """Array of (low, high) that covers all lags of a text of `size` bytes; each doubling of the lag takes the same time."""
    doublings = F.ceil(F.log2(size.cast("double") / (2 * MIN_EXP) + 2)).cast("int")
    ranges = F.least(doublings, F.ceil(size / long_bytes).cast("int"))
    edge = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(j * doublings / ranges).cast("int"))
    return F.transform(F.sequence(F.lit(0), ranges - 1), lambda j: F.struct(edge(j).alias("low"), edge(j + 1).alias("high")))


def find_runs(docs: DataFrame, rewrite: Rewrite | None = None, long_bytes: int = LONG_BYTES) -> DataFrame:
    """doc_id, n_runs, runs (by start, then period), top (the greatest exponent; null without runs), text (collapsed)."""
    small_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.octet_length("text") >= long_bytes, F.lit(False))
    near = docs.filter(~is_long).mapInArrow(lambda b: _collapse(b, rewrite), _OUT)
    # rows with the same key are the same row
    far = docs.filter(is_long).withColumn("key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), "text"), 256))
    tasks = far.select("*", F.explode(lag_ranges(F.octet_length("text"), long_bytes)).alias("lags")).select("key", "doc_id", "text", "lags.low", "lags.high")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = tasks.repartition(n, "key", "low").mapInArrow(lambda b: _ranges(b, rewrite), "key string, start long, length long, period long")
    # a document's runs are fewer than its words, which one row holds anyway
    runs = found.groupBy("key", "start", "length").agg(F.min("period").alias("period")).groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    split = far.join(runs, "key", "left").select("doc_id", "text", "runs").mapInArrow(lambda b: _collapse(b, rewrite), _OUT)
    return near.unionByName(split)


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The query's rewriting: one document in ten, by a checksum of its id, repeats a part of itself up to its end."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), planted)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES: dict[str, str] = {}
