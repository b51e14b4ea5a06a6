from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from calibra.llm import mixing

TARGETS = {"source": {f"s{i}": 1 / 5 for i in range(5)}, "lang": {"en": 0.5, "de": 0.3, "fr": 0.2}, "topic": {"prose": 0.9, "*": 0.1}}


def test_raked_marginals_meet_targets():
    rng = random.Random(1)
    cells = [(s, lang, t, rng.randrange(100, 10_000) * (8 if s == "s0" else 1)) for s in TARGETS["source"] for lang in TARGETS["lang"] for t in ("prose", "*")]
    found = mixing.probabilities([[c[d] for c in cells] for d in range(3)], [c[3] for c in cells], TARGETS, 0.05)
    p = {c[:3]: v for c, v in zip(cells, found.tolist(), strict=True)}
    kept = {c[:3]: c[3] * p[c[:3]] for c in cells}
    total = sum(kept.values())
    assert total == pytest.approx(0.05 * sum(c[3] for c in cells)) and max(p.values()) <= 1
    for d, dim in enumerate(mixing.DIMS):
        for v, share in TARGETS[dim].items():
            assert sum(x for k, x in kept.items() if k[d] == v) / total == pytest.approx(share, abs=1e-4)


def test_caps_and_missing_targets():
    p = mixing.probabilities([["a", "b", "*"], ["en"] * 3, ["prose"] * 3], [10, 1000, 500], {"source": {"a": 0.9, "b": 0.1, "gone": 0.5}, "lang": {}, "topic": {}}, 0.9)
    assert p[0] == pytest.approx(1) and (0 <= p).all() and (p <= 1).all()
    one = mixing.rake(np.array([3.0]), [np.array([0])] * 3, [np.array([1.0])] * 3)
    assert one.tolist() == [1.0]


def test_frames(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randrange(1, 40), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", None])) for i in range(6000)] + [(4001, None, "en", "s0"), (4002, "", "en", "s1"), (4002, "", "en", "s1"), (4003, "LOUD!!! " * 9, "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("topic_", F.lit(1))
    targets = {"source": {"s0": 0.4, "s1": 0.4, "(none)": 0.2}, "lang": {"en": 0.5, "de": 0.25, "(none)": 0.25}, "topic": {"prose": 1.0}}
    found = mixing.mix(df, targets, budget=0.3)
    got = found.collect()
    assert len(got) == len(rows) and all(0 <= r["probability"] <= 1 for r in got)
    kept = [r for r in got if r["kept"]]
    total = sum(r["tokens"] for r in kept)
    for dim, goal in targets.items():
        for v, share in goal.items():
            assert sum(r["tokens"] for r in kept if r[dim] == v) / total == pytest.approx(share, abs=0.05)
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)  # the join by a shuffle
    assert sorted(got, key=repr) == sorted(mixing.mix(df, targets, budget=0.3).collect(), key=repr)
    again = {r["doc_id"] for r in mixing.sample(df, targets=targets, budget=0.3).collect()}
    assert again == {r["doc_id"] for r in kept} and mixing.sample(df, targets=targets).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.sample(df.limit(0)).count() == 0
    assert sorted(got, key=repr) == sorted(mixing.mix(df, targets, budget=0.3).collect(), key=repr)


def test_query_against_slow_raking(spark, tmp_path):
    """Tokens, topics, raked probabilities and draws of the query by plain loops, with more sources than any list holds."""
    rng = random.Random(4)
    texts = ["word " * 9, "Licensed under the MIT License.", "mail a.b@c.de now", "if (x) { y(); }", "1234 5678 90 11 22", "STOP!!! NOW!!!", "", None, "né 12-3 x"]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None]), f"s{rng.randrange(1200)}" if i % 3 else "hot") for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in mixing.op8_source_mixing(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    topic = dict(zip(texts, ["prose", "legal", "contact", "code", "figures", "loud", "prose", "prose", "figures"], strict=True))
    tokens = {t: max(1, len(regex.findall(mixing.TOKEN, t or ""))) for t in texts}
    cells = Counter()
    for i, t, lang, source in rows:
        key = (source, lang or "(none)", topic[t])
        assert (got[i]["source"], got[i]["lang"], got[i]["topic"], got[i]["tokens"]) == (*key, tokens[t])
        cells[key] += tokens[t]
    total, goals = sum(cells.values()), []
    for d in range(3):
        own = Counter()
        for k, n in cells.items():
            own[k[d]] += n
        scale = sum((v / total) ** 0.7 for v in own.values())
        goals.append({k: (v / total) ** 0.7 / scale for k, v in own.items()})
    kept = {k: float(n) for k, n in cells.items()}
    for _ in range(50):
        x = {k: v / sum(kept.values()) for k, v in kept.items()}
        for _ in range(100):
            moved = 0.0
            for d in range(3):
                sums = Counter()
                for k, v in x.items():
                    sums[k[d]] += v
                f = {k: goals[d][k] / v for k, v in sums.items()}
                x = {k: v * f[k[d]] for k, v in x.items()}
                moved = max(moved, *(abs(v - 1) for v in f.values()))
            if moved < 1e-6:
                break
        scale = sum(x.values())
        kept = {k: min(v / scale * total / 2, cells[k]) for k, v in x.items()}
        if sum(kept.values()) >= total / 2 * (1 - 1e-6):
            break
    for r in got.values():
        k = (r["source"], r["lang"], r["topic"])
        assert r["probability"] == pytest.approx(kept[k] / cells[k], abs=1e-6)
    share = sum(r["tokens"] for r in got.values() if r["kept"]) / total
    assert share == pytest.approx(sum(kept.values()) / total, abs=0.03)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, "a b c", "en", "s", 1, 2.0) for i in range(50)], "doc_id long, text string, lang string, source string, _cell_source int, _p double")
    out = mixing.sample(df, budget=1.0)
    assert out.columns == df.columns and out.count() == 50
