from __future__ import annotations

import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from calibra.llm import bpe


@pytest.fixture(scope="module")
def pair():
    raw = open(P.path(bpe.VOCAB), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return bpe.ByteBPE(raw, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(coder, text):
    packed = coder.encode_packed(text)
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_same_ids_as_the_library(pair):
    mine, theirs = pair
    rng = random.Random(1)
    parts = ["a", "th", "ing", "tion", " ", "  ", "\n", "\n\n", "é", "12", "'s", "!", "#", "\t", "日本", "😀", "​", "\x85", "\x1c", "á"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 30)))
        assert ids(mine, t) == theirs.encode_ordinary(t), t
    for t in ("", " ", "\n", "ab" * 3000, "a" * 5000, " " * 3000, "<|endoftext|>"):
        assert ids(mine, t) == theirs.encode_ordinary(t)


def test_every_character(pair):
    mine, theirs = pair
    for low in range(0, 0x110000, 997):
        t = "".join(f"a{chr(c)}{chr(c)} 1" for c in range(low, low + 40) if not 0xD800 <= c < 0xE000 and c < 0x110000)
        assert ids(mine, t) == theirs.encode_ordinary(t)


def test_long_texts_in_parts(pair, monkeypatch):
    mine, theirs = pair
    monkeypatch.setattr(bpe, "_MANY_CHARS", 50)
    for memo in (mine.words, mine.spaced, mine.fits):
        monkeypatch.setattr(memo, "most", 2000)
        monkeypatch.setattr(memo, "room", 2000)
    t = "the and  of\n that is  a thing, " * 20
    assert ids(mine, t) == theirs.encode_ordinary(t)


def test_frames(spark, pair):
    _, theirs = pair
    rows = [(1, "the thing"), (2, None), (3, ""), (4, "the thing"), (None, "x  y\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(df).collect()}
    want = set()
    for i, t in rows:
        e = theirs.encode_ordinary(t or "")
        want.add((i, len(e), hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    back = bpe.decode(bpe.encode(df)).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    assert bpe.round_trip(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df.withColumnRenamed("doc_id", "ids"))
