from __future__ import annotations

import hashlib
import random

from calibra.llm import ctph


def slow_fingerprint(text):
    """The definition in plain loops: every block size from the largest down, every byte."""
    data = (text or "").encode()
    if not data:
        return "1::"
    rolled = []
    for i in range(len(data)):
        h = 0
        for k in range(min(ctph.WINDOW, i + 1)):
            x = int(ctph._TABLE[data[i - k]])
            h ^= (x << k | x >> (32 - k)) & 0xFFFFFFFF if k else x
        rolled.append(h)
    mixed = [(h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF for h in rolled]
    ends = lambda size: [i for i, m in enumerate(mixed) if (m ^ m >> 13) % size == size - 1]
    size = 1
    while len(ends(size)) >= ctph.LONGEST:
        size *= 2

    def signature(size):
        out, total = "", 0
        last = set(ends(size))
        for i, m in enumerate(mixed):
            total += m
            if i in last or i == len(mixed) - 1:
                out += ctph._ALPHABET[(total * 0x9E3779B1 & 0xFFFFFFFF) >> 26]
                total = 0
        return out

    return f"{size}:{signature(size)}:{signature(2 * size)}"


def test_fingerprint_against_plain_loops():
    rng = random.Random(12)
    for n in [0, 1, 2, 5, 6, 7, 8, 63, 64, 65, 127, 200, 700, 3000]:
        for letters in ("ab", "abcdefgh é\n", "a"):
            t = "".join(rng.choice(letters) for _ in range(n))
            assert ctph.fingerprint(t) == slow_fingerprint(t)
    assert ctph.fingerprint(None) == slow_fingerprint(None)


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = slow_fingerprint(t), slow_fingerprint(e), slow_fingerprint(nxt)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, ctph.likeness(a, b), ctph.likeness(a, c)))
    return out


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ctph, "STRETCH_BYTES", 300)
    rows = [(i * 3 % 101, f"héllo {i} wörld " * (i % 17)) for i in range(101)] + [(200, None), (201, ""), (202, "same"), (203, "same"), (None, "no id"), (203, "other text of the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, ctph.fingerprints(df).collect()), key=repr) == sorted(brute(rows), key=repr)


def test_single_row_and_empty(spark):
    df = spark.createDataFrame([(7, "alone here")], "doc_id long, text string")
    r = ctph.fingerprints(df).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"alonealone").hexdigest()
    assert ctph.fingerprints(df.limit(0)).count() == 0


def test_likeness():
    rng = random.Random(4)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(5000)) for _ in range(2))
    fa, fb = ctph.fingerprint(a), ctph.fingerprint(b)
    assert ctph.likeness(fa, fa) == 1 and ctph.likeness(fa, fb) < 0.2
    assert ctph.likeness(fa, ctph.fingerprint(a[:2500] + b[:2500])) > 0.35
    assert ctph.likeness(fa, ctph.fingerprint(a[:2400] + "X" + a[2400:])) > 0.9
    assert ctph.likeness(fa, ctph.fingerprint(a * 2)) > 0.3  # neighbouring block sizes are comparable
    assert ctph.likeness(fa, ctph.fingerprint("tiny")) == 0


def test_edit_distance_is_exact():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b):
                prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 70))) for _ in range(2))
        assert ctph._common(a, b) == slow(a, b)
