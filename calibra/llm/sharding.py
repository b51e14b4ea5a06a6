"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by (hash of the text, id), so copies of a text stand together. A size-weighted sample of the keys
gives quantile boundaries; the boundaries cut the key space into ranges, more of them the more records there are, and a
range that turns out overfull is sampled again and subdivided. Ranges are sorted by a task each; exact sums of sizes over ranges then place every
record, and shard i takes the bytes from i/n to (i+1)/n of the total. Law: `bytes`. Copies of a text stay in one shard
when together they take at most 1/WHOLE_GROUPS of a shard's share; larger groups are cut where a shard is full.

Sizes are UTF-8 bytes plus 8; a null text has no bytes and counts as empty. Rows with a null id come first among
copies; repeated rows lie side by side and each has its own slot. An empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.llm._common import cut, table

SHARDS, WHOLE_GROUPS = 24, 64
#: Ranges per shard at least, records in a range, expected sample keys per range, what makes a range overfull (times the mean).
RANGES, RANGE_ROWS, DRAWS, OVERFULL, ROUNDS = 8, 500_000, 48, 2.0, 3


def _key(text: str) -> Column:
    """60 bits of a text's MD5, as a number that any SQL engine can make."""
    return F.conv(F.substring(F.md5(F.col(text).cast("binary")), 1, 15), 16, 10).cast("long")


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below (k, d), by binary search over a constant array."""
    if not splitters:
        return F.lit(0)
    ks, ds = (F.array(*(F.lit(s[i]) for s in splitters)) for i in (0, 1))
    depth = len(splitters).bit_length()

    def halve(lo: Column, step: Column) -> Column:
        at = lo + step
        k, d = F.get(ks, at - 1), F.get(ds, at - 1)
        below = (at <= len(splitters)) & ((k < F.col("k")) | ((k == F.col("k")) & (d <= F.col("d"))))
        return F.when(below, at).otherwise(lo)

    return F.aggregate(F.array(*(F.lit(1 << b) for b in range(depth - 1, -1, -1))), F.lit(0), halve)


def _quantiles(rows: DataFrame, total: int, ranges: int) -> list[tuple[int, int]]:
    """Boundaries from a size-weighted sample: a record of size s is drawn s * DRAWS * ranges / total times on average."""
    x = F.col("size") * (DRAWS * ranges / total)
    u = F.pmod(F.xxhash64("k", "doc_id", F.lit(total)), F.lit(1 << 20)) / float(1 << 20)
    drawn = rows.withColumn("m", F.floor(x + u).cast("int")).filter("m > 0")
    keys = F.array_sort(F.flatten(F.collect_list(F.array_repeat(F.struct("k", "d"), F.col("m")))))
    one = drawn.agg(keys.alias("a")).select(F.expr(f"transform(filter(sequence(1, {ranges - 1}), i -> size(a) > 0), i -> element_at(a, cast(floor(i * size(a) / {ranges}) as int) + 1))").alias("q"))
    found = one.first()["q"] if ranges > 1 else []
    return sorted({(r["k"], r["d"]) for r in found})


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row of docs."""
    low = -(1 << 63)
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), content.alias("_t")).select("doc_id", (F.octet_length("_t") + 8).cast("long").alias("size"), F.crc32(F.col("_t").cast("binary")).alias("text_crc32"), _key("_t").alias("k"))
    rows = cut(rows)
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    ranges = max(shards * RANGES, -(-n // RANGE_ROWS))
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    whole = total / shards / WHOLE_GROUPS
    heavy = rows.groupBy("k").agg(F.sum("size").alias("_g")).filter(F.col("_g") > whole).select("k", F.lit(True).alias("heavy"))  # at most shards * WHOLE_GROUPS rows
    rows = rows.join(F.broadcast(heavy), "k", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))).withColumn("d", F.when(F.col("heavy"), F.coalesce("doc_id", F.lit(low))).otherwise(F.lit(low)))
    splitters = _quantiles(rows, total, ranges)
    for _ in range(ROUNDS):
        filled = rows.groupBy(_range_of(splitters).alias("range")).agg(F.sum("size").alias("b"), F.max("size").alias("most"), F.min(F.struct("k", "d")).alias("lo"), F.max(F.struct("k", "d")).alias("hi"))
        full = filled.filter((F.col("b") > OVERFULL * total / ranges) & (F.col("lo") < F.col("hi")) & (F.col("b") > 2 * F.col("most"))).collect()  # at most ranges / OVERFULL rows
        if not full:
            break
        inside = rows.filter(_range_of(splitters).isin([r["range"] for r in full]))
        part = sum(r["b"] for r in full)
        splitters = sorted({*splitters, *_quantiles(inside, part, 2 + int(2 * part * ranges / total))})
    order = Window.partitionBy("range").orderBy("k", "d", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    ranged = rows.withColumn("range", _range_of(splitters))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sums.select("range", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    group = Window.partitionBy("range", "k")
    placed = ranged.withColumn("_at", F.coalesce(F.sum("size").over(upto), F.lit(0))).withColumn("_start", F.min("_at").over(group)).withColumn("_bytes", F.sum("size").over(group))
    centre = F.when(F.col("heavy"), 2 * F.col("_at") + F.col("size")).otherwise(2 * F.col("_start") + F.col("_bytes")) + 2 * F.col("b0")
    share = F.expr(f"least({shards - 1}, cast((centre * {shards}) div ({2 * total}) as int))")
    placed = cut(placed.join(F.broadcast(offsets), "range").withColumn("centre", centre).select("doc_id", "size", "text_crc32", "k", "d", "range", share.alias("shard")))
    pieces = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))  # at most ranges + shards rows
    first = pieces.select("shard", "range", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s0"))
    within = Window.partitionBy("range", "shard").orderBy("k", "d", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    return placed.join(F.broadcast(first), ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", (F.col("s0") + F.row_number().over(within) - 1).alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_sharding": op2_sharding}
#: The same law from one running sum over all records; the CRC table follows from its polynomial.
ORACLES = {
    "op2_sharding": f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
b AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
r AS (SELECT doc_id, CAST(len(b) + 8 AS BIGINT) AS size, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS k,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, y: xor(c // 256, t[xor(c, y) % 256 + 1])), 4294967295) AS text_crc32 FROM b, crc),
g AS (SELECT *, sum(size) OVER (PARTITION BY k) AS gb, sum(size) OVER () AS total, sum(size) OVER (ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS pos FROM r),
p AS (SELECT *, CASE WHEN gb > total / {SHARDS} / {WHOLE_GROUPS} THEN 2 * pos + size ELSE 2 * min(pos) OVER (PARTITION BY k) + gb END AS centre FROM g),
s AS (SELECT *, CAST(least({SHARDS - 1}, centre * {SHARDS} // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
}
