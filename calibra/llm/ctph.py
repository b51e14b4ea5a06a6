"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last WINDOW bytes decides where a chunk ends: where it is -1 modulo the block size. Each chunk
becomes one character of a signature. The block size is the least power of two that leaves at most LONGEST chunks;
a fingerprint holds the signatures at that size and at twice that size, so texts of unlike length stay comparable.
Two fingerprints are compared at a block size they share, by the edit distance (insertions and deletions) of their
signatures: likeness = 1 - distance / (sum of lengths). Signatures without a common run of RUN characters are unlike
(0); equal fingerprints are alike (1). Texts that repeat one short phrase have few kinds of chunks, hence short signatures.

A null text counts as empty; the fingerprint of the empty text is `1::`. Texts of any length are read whole. "Next"
goes by ascending id (null ids first, ties by text), and the last document is followed by the first. Rows that are
repeated follow each other. A single row follows itself. An empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm._common import slices, small_batches, table

WINDOW, LONGEST, RUN = 7, 64, 4
#: Expected UTF-8 bytes in a stretch of neighbouring documents. A task reads some stretches in order, a row at a time, so
#: that with more than STRETCHES times as much they grow, and its memory does not.
STRETCH_BYTES, STRETCHES = 4_000_000, 65_536
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(_ALPHABET.encode(), np.uint8)
_TABLE = np.random.default_rng(20240501).integers(0, 2**32, 256, np.uint32)
_ROTATED = [(_TABLE << np.uint32(k)) | (_TABLE >> np.uint32(32 - k)) if k else _TABLE for k in range(WINDOW)]


def _rolling(b: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW bytes at each position (fewer at the start)."""
    h = _ROTATED[0][b]
    for k in range(1, min(WINDOW, len(b))):
        h[k:] ^= _ROTATED[k][b[:-k]]
    return h


def _signature(mixed: np.ndarray, ends: np.ndarray) -> str:
    """One character per chunk, from the sum of the mixed rolling hashes in it."""
    starts = np.concatenate([[0], ends[ends < len(mixed) - 1] + 1])
    sums = np.add.reduceat(mixed, starts, dtype=np.uint32)
    return _LETTERS[(sums * np.uint32(0x9E3779B1)) >> np.uint32(26)].tobytes().decode()


def _ends(hashes: np.ndarray, size: int) -> np.ndarray:
    return np.flatnonzero((hashes & np.uint32(size - 1)) == size - 1)


def fingerprint(text: str | None) -> str:
    b = np.frombuffer((text or "").encode(), np.uint8)
    if not len(b):
        return "1::"
    h = _rolling(b)
    mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    trailing = mixed ^ (mixed >> np.uint32(13))
    size = 1 << max(0, (len(b) // LONGEST - 1).bit_length() - 1)
    ends = _ends(trailing, size)
    while len(ends) >= LONGEST:
        size *= 2
        ends = ends[(trailing[ends] & np.uint32(size - 1)) == size - 1]
    while size > 1 and len(finer := _ends(trailing, size // 2)) < LONGEST:
        size, ends = size // 2, finer
    coarse = ends[(trailing[ends] & np.uint32(2 * size - 1)) == 2 * size - 1]
    return f"{size}:{_signature(mixed, ends)}:{_signature(mixed, coarse)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    n = min(RUN, len(a), len(b))
    runs = {a[i : i + n] for i in range(len(a) - n + 1)}
    if not any(b[i : i + n] in runs for i in range(len(b) - n + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """From 0 to 1; block sizes that differ by more than a factor of two are not comparable (0)."""
    if a == b:
        return 1.0
    (n, a1, a2), (m, b1, b2) = a.split(":"), b.split(":")
    n, m = int(n), int(m)
    if n == m:
        return max(_alike(a1, b1), _alike(a2, b2))
    if n == 2 * m:
        return _alike(a1, b2)
    if m == 2 * n:
        return _alike(a2, b1)
    return 0.0


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, text) dealt into stretches of neighbours, in order; each stretch ends with the first document of the next.

    Gives columns stretch, guest, doc_id, text. Boundaries are quantiles of the id, as many as the bytes ask for.
    """
    low = F.lit(-(1 << 63))
    docs = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), low))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(STRETCHES, -(-total // STRETCH_BYTES)))
    points = docs.agg(F.percentile_approx("_id", [i / n for i in range(1, n)], max(10_000, 40 * n))).first()[0] if n > 1 else None
    bounds = sorted(set(points or []))
    array = F.array(*map(F.lit, bounds)) if bounds else None
    depth = len(bounds).bit_length()
    at = lambda lo, step: F.when((lo + step <= len(bounds)) & (F.get(array, lo + step - 1) <= F.col("_id")), lo + step).otherwise(lo)
    stretch = F.aggregate(F.array(*(F.lit(1 << b) for b in range(depth - 1, -1, -1))), F.lit(0), at) if bounds else F.lit(0)
    docs = docs.withColumn("stretch", stretch)
    firsts = sorted((r[0], r[1]) for r in docs.groupBy("stretch").agg(F.min("_id")).collect())  # a row for each stretch
    before = {firsts[i][1]: firsts[i - 1][0] for i in range(len(firsts))}
    table_of = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else None
    target = F.try_element_at(table_of, F.col("_id")) if before else F.lit(None).cast("int")
    places = F.array_compact(F.array(F.struct("stretch", F.lit(False).alias("guest")), F.when(target.isNotNull(), F.struct(target.alias("stretch"), F.lit(True).alias("guest")))))
    parts = max(1, len(firsts) // 4)
    dealt = docs.select(F.explode(places).alias("p"), "_id", "doc_id", "text").select("p.stretch", "p.guest", "_id", "doc_id", "text")
    return dealt, parts


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row."""

    def close(prev: tuple, text: str, mark: str) -> tuple:
        doc, own, own_mark = prev
        half = len(own) // 2
        edited = own[: len(own) - half] + text[:half]
        edited_mark = fingerprint(edited)
        return doc, len(own), hashlib.sha256(edited.encode()).hexdigest(), own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev, in_stretch, ended = None, None, False
        for batch in slices(batches, "text"):
            out = []
            for stretch, guest, doc, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stretch != in_stretch:
                    prev, in_stretch, ended = None, stretch, False
                if ended:
                    continue
                t = t or ""
                mark = fingerprint(t)
                if prev:
                    out.append(close(prev, t, mark))
                prev, ended = (doc, t, mark), guest
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    small_batches(docs)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    dealt, parts = with_next(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    ordered = dealt.repartition(parts, "stretch").sortWithinPartitions("stretch", "guest", "_id", "text").select("stretch", "guest", "doc_id", "text")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
ORACLES: dict[str, str] = {}
