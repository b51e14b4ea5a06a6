from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from calibra.llm import bpe, langid, mixing, ngram_join, pii

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    words = {"en": "the of and to in that is was for with nation".split(), "de": "der die und das nicht ist mit ein auf schön".split()}
    rows = []
    for i in range(300):
        k = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[k]) + rng.choice(["", "", "s", "er", "ly"]) for _ in range(rng.randrange(30, 80))), k, rng.choice(["s0", "s0", "s1", None]), 1))
    rows += [(1000 + i, rows[3][1], "en", "s0", 1) for i in range(40)]  # a hot group of copies
    rows += [(2000, None, None, None, None), (2001, "", "en", "s0", 0), (2002, "!!! 123", "en", "s0", 7), (2003, "the nation and the mail of und.34@mail7.example.com is that with in for", "en", "s1", 70), (2003, "the nation and the mail of und.34@mail7.example.com is that with in for", "en", "s1", 70), (None, rows[9][1] + " und der", "en", "s1", 1), (2005, "the and of that is " * 4000, "en", "s1", 76000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)).repartition(5)


def test_language_stage(spark, docs):
    out = cp.known_language(spark, docs, "")
    assert out.columns == COLUMNS
    model = langid.train(docs.filter(~langid.held_out()))
    want = sorted(str(r["doc_id"]) for r in docs.collect() if not model.predict(r["text"])[2])
    assert sorted(str(r["doc_id"]) for r in out.collect()) == want
    assert not {"2000", "2001", "2002"} & set(want) and "2003" in want


def test_near_duplicate_stage(spark, docs):
    out = cp.distinct_texts(spark, docs, "")
    assert out.columns == COLUMNS
    got = [r["doc_id"] for r in out.collect()]
    comp = {r["doc_id"]: r["component_id"] for r in ngram_join.link_components(docs).collect()}
    assert {g for g in got if g is not None} == {d for d, c in comp.items() if d is not None and d == c}
    assert len(got) == len(set(got)) and None not in got  # the row without an id is a near copy of row 9
    assert sum(g is not None and g >= 1000 and g < 1040 for g in got) <= 1


def test_near_duplicate_stage_keeps_one_row_of_repeats_and_of_null_ids(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (None, "h i j k l m n", "en", "s", 13), (None, "h i j k l m n", "en", "s", 13), (None, "o p q r s t u", "en", "s", 13), (None, None, None, None, None), (3, "", "en", "s", 0), (4, None, "en", "s", 0)]
    out = cp.distinct_texts(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, "a b c d e f g"), (None, "h i j k l m n"), (None, "o p q r s t u"), (None, None), (3, ""), (4, None)], key=repr)


def test_pii_stage(spark, docs):
    out = cp.without_pii(spark, docs, "").collect()
    made = pii.Surrogates(pii.key_of(spark))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out:
        assert r["text"] == (None if texts[r["doc_id"]] is None else made.replace(texts[r["doc_id"]])[0])
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert not any("und.34@mail7" in (r["text"] or "") for r in out)


def test_mixing_stage(spark, docs):
    out = cp.mixed(spark, docs, "")
    assert out.columns == COLUMNS
    kept = {r["doc_id"] for r in mixing.mix(docs, budget=0.8).filter("kept").collect()}
    assert {r["doc_id"] for r in out.collect()} == kept and kept


def test_token_stage(spark, docs):
    out = cp.tokens(spark, docs, "")
    back = bpe.decode(out).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert back and all(bytes(r["decoded"]) == (r["text"] or "").encode() and r["n_tokens"] == len(r["ids"]) for r in back)


def test_stages_take_empty_tables(spark, docs):
    for _, stage in cp.STAGES:
        assert stage(spark, docs.select(*COLUMNS).limit(0), "").count() == 0


def test_whole_pipeline(spark):
    assert [n for n, _ in cp.STAGES] == ["language_id", "ngram_jaccard", "pii_surrogates", "source_mixing", "byte_bpe"]
    out = cp.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns)
    assert 0 < out.count() < spark.read.parquet(f"{SF}/documents.parquet").count()
