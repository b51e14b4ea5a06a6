from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from calibra.llm import sharding


def brute(rows, n=sharding.SHARDS):
    recs = []
    for i, t in rows:
        b = (t or "").encode()
        recs.append((int(hashlib.md5(b).hexdigest()[:15], 16), i, len(b) + 8, zlib.crc32(b)))
    total = sum(r[2] for r in recs)
    groups = {}
    for r in recs:
        groups[r[0]] = groups.get(r[0], 0) + r[2]
    recs.sort(key=lambda r: (r[0], -(1 << 63) if r[1] is None else r[1]))
    at, start, out, slots = 0, {}, [], {}
    for k, i, size, crc in recs:
        start.setdefault(k, at)
        centre = 2 * at + size if groups[k] > total / n / sharding.WHOLE_GROUPS else 2 * start[k] + groups[k]
        s = min(n - 1, centre * n // (2 * total))
        out.append((i, size, crc, s, slots.get(s, 0)))
        slots[s] = slots.get(s, 0) + 1
        at += size
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in sharding.shard(df).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    return got


def test_same_as_brute_force(spark):
    rows = [(i, f"text {i * i % 977} " * (i % 40)) for i in range(900)] + [(1000 + i, "copy " * 30) for i in range(400)] + [(2000, None), (2001, ""), (None, "no id")]
    got = check(spark, rows)
    sizes = {}
    for r in got:
        sizes[r[3]] = sizes.get(r[3], 0) + r[1]
    mean = sum(sizes.values()) / sharding.SHARDS
    assert len(sizes) == sharding.SHARDS and max(sizes.values()) < 1.1 * mean and min(sizes.values()) > 0.9 * mean
    for s in sizes:
        assert sorted(r[4] for r in got if r[3] == s) == list(range(sum(r[3] == s for r in got)))


def test_small_and_empty(spark):
    check(spark, [(1, "a")])
    check(spark, [(1, None), (1, None)])
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "DRAWS", 0.05)  # hardly any sample: the first splitters are poor
    check(spark, [(i, "x" * (i % 50)) for i in range(2000)])


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 3, 4, "z")], "doc_id long, text string, size int, shard int, k string")
    assert sharding.shard(df).columns == ["doc_id", "size", "text_crc32", "shard", "slot"]


def test_no_python_in_the_plan(spark):
    df = sharding.shard(spark.createDataFrame([(i, "t" * i) for i in range(50)], "doc_id long, text string").withColumn("text", F.col("text")))
    assert not any(w in df._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas"))
