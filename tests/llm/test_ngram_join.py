from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from calibra.llm import _common, graph, ngram_join


def brute(rows, width, percent):
    def words(t):
        return (t or "").encode().translate(ngram_join._FOLD).split()

    sets = {d: (set() if not (w := words(t)) else {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}) for d, t in rows}
    lists, shared = defaultdict(list), Counter()
    for d, s in sets.items():
        for x in s:
            lists[x].append(d)
    for found in lists.values():
        shared.update((a, b) for i, a in enumerate(found) for b in found[i + 1 :])
    root, links = {d: d for d in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            links.update((a, b))
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d), links[d]) for d, s in sets.items()}


def families(seed=5):
    rng, rows = random.Random(seed), []
    for k in range(10):
        w = [rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(rng.randrange(3, 150))]
        for j in range(20):
            v = list(w)
            for _ in range(rng.randrange(0, 1 + len(w) // 20)):
                v[rng.randrange(len(v))] = rng.choice("xyz") * 2
            rows.append((100 * k + j, " ".join(v)))
    passage = " ".join(rng.choice("klmnop") for _ in range(60))
    rows += [(5000 + i, " ".join(rng.choice("abcdef") * rng.randrange(1, 5) for _ in range(rng.randrange(20, 90))) + " " + passage) for i in range(60)]
    rows += [(7000 + i, "copy of one text here") for i in range(30)]
    return [*rows, (9000, None), (9001, ""), (9002, " \n\t"), (9003, "A b"), (9004, "a B"), (9005, "one"), (9006, "a b c")]


@pytest.mark.parametrize(("width", "percent", "block"), [(5, 80, 1_500_000), (3, 90, 1_500_000), (3, 90, 1500), (2, 60, 1500)])
def test_same_as_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(_common, "SLICE_BYTES", 1500 if block < 10_000 else 4 << 20)
    monkeypatch.setattr(ngram_join, "SAMPLE", 2 if block < 10_000 else 64)
    rows = families()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in ngram_join.link_components(df, width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a b c d", "x"), (2, "A B C D", "y")], "doc_id long, text string, n_shingles string")
    got = sorted(map(tuple, ngram_join.link_components(df, 3, 90).collect()), key=repr)
    assert got == sorted([(1, 2, 1, 2), (1, 2, 1, 2), (None, 2, None, 0), (2, 2, 1, 2)], key=repr)
    assert ngram_join.link_components(df.limit(0), 3, 90).count() == 0


def test_one_id_with_two_texts_keeps_the_links_of_both(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y")]
    got = {tuple(r) for r in ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 3, 90).collect()}
    assert got == {(1, 38, 1, 1), (2, 39, 1, 1), (3, 39, 1, 1)}


def test_signatures_never_miss():
    rng = np.random.default_rng(0)
    for percent in (60, 80, 90):
        c = ngram_join.Classes(percent)
        for _ in range(300):
            n = int(rng.integers(1, 120))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            keep = int(np.ceil(len(a) * percent / 100))
            b = a[np.sort(rng.permutation(len(a))[:keep])]  # the smallest subset that still links
            assert 100 * len(b) >= percent * len(a)
            assert set(c.signatures(a).tolist()) & set(c.signatures(b).tolist())
            for share in (0.1, 0.5, 0.95):  # whatever shingles count as frequent
                f = np.sort(a[rng.random(len(a)) < share])
                assert set(c.signatures(a, f).tolist()) & set(c.signatures(b, f).tolist())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 200), (7, 3)]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
