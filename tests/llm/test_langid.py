from __future__ import annotations

import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.llm import langid

WORDS = {"en": "the of and to in that is was for with thing nation over", "de": "der die und das nicht ist mit ein auf für schön über", "es": "el la que de los para una con por niño más años"}


def text(lang, rng, n=40):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, text(k, rng), k) for i in range(600) for k in [rng.choice(list(WORDS))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(docs):
    return langid.train(docs.filter(~langid.held_out()), rows_per_lang=100)


def test_held_out_accuracy(docs, model):
    r = langid.predict(docs.filter(langid.held_out()), model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.97


def test_rejects_and_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !!! ..."), (4, "жщюя ъыэё жщюя"), (5, "THE NATION WAS OVER THE THING"), (6, "the and that " * 50000), (None, "der und nicht ist")]
    df = spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, lang string, other double")
    rows += [(7, "½ ² Ⅷ 12"), (8, "ª 12")]
    df = spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, lang string, other double")
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in langid.predict(df, model).collect()}
    assert got[1] == got[2] == got[3] == got[7] == (langid.UNKNOWN, 0.0, True)
    assert got[4][0] in model.langs and 0 < got[4][1] < 0.6 and got[4][2]
    assert got[8][0] in model.langs  # category Lo is a letter, No and Nl are none
    assert got[5][::2] == ("en", False) and got[6][::2] == ("en", False) and got[None][::2] == ("de", False)
    with pytest.raises(ValueError):
        langid.predict(df.withColumnRenamed("other", "score"), model)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    m = langid.train(df)
    assert langid.predict(df, m).first()["lang_pred"] == langid.UNKNOWN
    assert langid.predict(df.limit(0), m).count() == 0


def test_one_language_and_repeats(spark):
    df = spark.createDataFrame([(1, "eins zwei", "de"), (1, "eins zwei", "de"), (2, "drei", "de")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(df, langid.train(df)).collect()} == {"de"}


def test_training_is_bounded_and_stable(docs):
    a, b = (langid.train(docs, rows_per_lang=20) for _ in range(2))
    assert a.langs == b.langs and (a.scores == b.scores).all()


def test_every_language_is_learned_whatever_their_number(spark):
    rows = [(100 * k + i, f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + k % 7)} " * 20, f"l{k:03d}") for k in range(100) for i in range(3)]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.langs == [f"l{k:03d}" for k in range(100)]


def test_query_against_slow_predictions(spark, tmp_path):
    """The query's rows from the model's scores by plain loops over the n-grams."""
    rng = random.Random(9)
    rows = [(i, text(k, rng), k) for i in range(300) for k in [rng.choice(list(WORDS))]] + [(400, None, "en"), (401, "12 ½", None), (402, "Ünïcödé--WORDS  and\tmore 12 words", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    m = langid.train(docs.filter(~langid.held_out()))
    got = {r["doc_id"]: r for r in langid.op4_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not any(unicodedata.category(c).startswith("L") for c in t or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        b = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", f" {t.lower()} ".encode())
        z, n = np.zeros(len(m.langs)), 0
        for width, mult in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
            for k in range(len(b) - width + 1):
                z += m.scores[int.from_bytes(b[k : k + width]) * mult % 2**32 >> 32 - langid.BUCKET_BITS]
                n += 1
        z = z / n + m.bias
        p = np.exp((z - z.max()) / m.temperature)
        p /= p.sum()
        assert got[i]["lang_pred"] == m.langs[int(p.argmax())] and abs(got[i]["score"] - p.max()) < 1e-5
        d = 0.0
        for width, mult in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
            for k in range(len(b) - width + 1):
                d += m.density[int(p.argmax())][int.from_bytes(b[k : k + width]) * mult % 2**32 >> 32 - langid.BUCKET_BITS]
        assert got[i]["rejected"] == (got[i]["score"] < m.least or d / n < m.least_density)


FOREIGN = {
    "nl": "De kinderen spelen in de tuin terwijl hun ouders in de keuken het avondeten klaarmaken en naar de radio luisteren.",
    "it": "I bambini giocano nel giardino mentre i genitori preparano la cena in cucina e ascoltano la radio con gli amici.",
    "pt": "As crianças brincam no jardim enquanto os pais preparam o jantar na cozinha e ouvem a rádio com os amigos.",
    "sv": "Barnen leker i trädgården medan föräldrarna lagar middag i köket och lyssnar på radion tillsammans med vänner.",
    "ru": "Дети играют в саду, пока родители готовят ужин на кухне и слушают радио.",
    "el": "Τα παιδιά παίζουν στον κήπο ενώ οι γονείς ετοιμάζουν το δείπνο στην κουζίνα και ακούν ραδιόφωνο.",
    "ja": "子供たちは庭で遊んでいて、両親は台所で夕食を作りながらラジオを聞いています。",
    "zh": "中" * 500,
    "mash": "asdkjh qwoeiu zxmcnb lkjasd poiqwe mnzxcb qlwkej asdlkj zmxncb qpwoei",
}
DOCUMENTS = "/root/testdata/sf0.01"


def test_foreign_texts_are_rejected_and_known_ones_are_not(spark):
    docs = spark.read.parquet(f"{DOCUMENTS}/documents.parquet").select("doc_id", "text", "lang")
    m = langid.train(docs.filter(~langid.held_out()))
    assert {k for k, v in FOREIGN.items() if not m.predict(v)[2]} == set()
    r = langid.predict(docs.filter(langid.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()), m)
    right, lost, n = r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count_if("rejected"), F.count("*")).first()
    assert right > 0.99 and lost <= 0.005 * n


@pytest.mark.parametrize("left_out", ["de", "es", "fr"])
def test_a_language_left_out_is_rejected(spark, left_out):
    """Recall of rejection on a language that nothing was learned of, and its cost on the others."""
    docs = spark.read.parquet(f"{DOCUMENTS}/documents.parquet").select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    m = langid.train(docs.filter(~langid.held_out() & (F.col("lang") != left_out)), rows_per_lang=100)
    shares = {r[0]: r[1] for r in langid.predict(docs.filter(langid.held_out()), m).groupBy(F.col("lang") == left_out).agg(F.avg(F.col("rejected").cast("int"))).collect()}
    assert shares[True] >= 0.9 and shares[False] <= 0.01
