from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from calibra.llm import periodic_runs

SCHEMA = "doc_id long, text string, runs string, key string, low int"


def brute_runs(words):
    """Every maximal stretch of every period, by plain loops; the period must be the smallest of its stretch."""
    n, out = len(words), []
    for q in range(1, n + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q] or (i and words[i - 1] == words[i - 1 + q]):
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def texts():
    r = random.Random(5)
    out = [None, "", " \x0b\r\n", "one", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "a\xa0b a\xa0b a\xa0b a\xa0b a\xa0b a\xa0b", "x x x x x x y y y y y y y " * 5, "a a b " * 6, "a " * 500]
    for period in (1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 50):
        unit = [r.choice("abcdefgh") for _ in range(period)]
        for length in (4 * period - 1, 4 * period, 4 * period + 3, 6 * period + 1):
            out.append(" ".join([r.choice("xyz") for _ in range(r.randrange(20))] + (unit * 9)[:length] + [r.choice("xyz") for _ in range(r.randrange(20))]))
    out += [" ".join(r.choice("ab") for _ in range(r.randrange(150))) for _ in range(60)]
    out += [" ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(300))) for _ in range(40)]
    return out


def test_query_same_as_brute_force(spark, tmp_path):
    docs = [(i, t, "clash", None, 1) for i, t in enumerate(texts())] + [(None, "a b " * 20, None, None, None), (None, None, None, None, None), (7, "other text of the id " * 9, None, None, None)] + [(11, texts()[11], None, None, None)] * 2
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((brute_row(d[0], d[1]) for d in docs), key=repr)
    assert sum(r[1] > 0 for r in got) > 60


@pytest.mark.parametrize("long_bytes", [1, 40, 300])
def test_split_by_lag_ranges(spark, long_bytes):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts())] + [(11, texts()[11], None, None, None), (None, "b " * 99, None, None, None)], SCHEMA)
    assert sorted(map(repr, periodic_runs.find_runs(docs, periodic_runs.planted, long_bytes).collect())) == sorted(map(repr, periodic_runs.find_runs(docs, periodic_runs.planted).collect()))


def test_ranges_cover_all_lags(spark):
    for size in (8, 9, 100, 4096, 10**6, 10**9):
        rows = spark.range(1).select(periodic_runs.lag_ranges(periodic_runs.F.lit(size), 64).alias("r")).first()["r"]
        assert rows[0]["low"] == 1 and rows[-1]["high"] > size // 2 // 4 and all(x["high"] == y["low"] for x, y in zip(rows[:-1], rows[1:], strict=True))


def test_grid_loses_no_run():
    r = random.Random(3)
    for _ in range(150):
        words = [r.choice("abc" if r.random() < 0.5 else "abcdefghijk") for _ in range(r.randrange(20, 400))]
        for _ in range(r.randrange(3)):
            p, at = r.randrange(1, 60), r.randrange(len(words))
            unit = words[at : at + p]
            words[at : at + 5 * len(unit)] = unit * 5
        words = words[:500]
        assert periodic_runs.smallest(periodic_runs.scan(np.array([ord(w) for w in words], np.int32))) == brute_runs(words)


def test_long_text_of_one_word_ends():
    assert periodic_runs.smallest(periodic_runs.scan(np.zeros(300_000, np.int32))) == [(0, 300_000, 1)]


def test_empty_table(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], SCHEMA)).collect() == []
