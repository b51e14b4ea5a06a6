from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from calibra.llm import suffix_dedup


def brute(rows, n):
    windows = Counter(b[i : i + n] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - n + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if windows[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdé ") for _ in range(2000))
    rows = []
    for i in range(150):
        t = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 500)))
        for _ in range(rng.randrange(0, 3)):
            a, k, p = rng.randrange(0, 1700), rng.randrange(60, 300), rng.randrange(0, len(t) + 1)
            t = t[:p] + base[a : a + k] + t[p:]
        rows.append((i, t))
    hot = [(400 + k, "".join(rng.choice("xyz") for _ in range(90)) + base[:150] + "".join(rng.choice("xyz") for _ in range(90))) for k in range(90)]
    return [*rows, *hot, (300, "ab" * 300), (301, None), (302, ""), (303, rows[5][1]), (303, rows[5][1]), (None, rows[6][1]), (None, rows[7][1] + "z")]


@pytest.mark.parametrize(("walk", "hot"), [(48, 20_000), (2, 20_000), (1000, 20_000), (48, 3)])
def test_same_as_brute_force(spark, monkeypatch, walk, hot):
    monkeypatch.setattr(suffix_dedup, "WALK", walk)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PIECE", 170)  # long texts in pieces
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 20_000)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = suffix_dedup.remove_repeats(df, 100, 60).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes").collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == brute(rows, 100)
    assert sorted(((r[0], r[1], r[5]) for r in found), key=repr) == [r[:3] for r in brute(rows, 60)]


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, "x" * 50, 2, "u")], "doc_id long, text string, d int, spans string")
    r = suffix_dedup.remove_repeats(df).first()
    assert (r["n_bytes"], r["n_removed"], bytes(r["kept"])) == (50, 0, b"x" * 50)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(8)
    for runs in (1, 2, 3, 5, 9):
        lists = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 30))) for _ in range(runs)]
        out = list(suffix_dedup.LoserTree([suffix_dedup.front_code(x) for x in lists]))
        merged = [o[3] for o in out]
        assert merged == sorted(s for x in lists for s in x)
        for before, (_, _, known, s) in zip(merged, out[1:]):
            assert known == suffix_dedup._shared(before, s)


def test_shared_prefix():
    rng = random.Random(1)
    for _ in range(500):
        a = bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 80)))
        b = a[: rng.randrange(0, len(a) + 1)] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40)))
        want = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert suffix_dedup._shared(a, b) == want
