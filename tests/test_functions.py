from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.functions import arrays as A
from calibra.functions import text as X
from calibra.operators import decide, fits, metrics, resample
from calibra.sources import readers, sinks


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("v")).first()["v"]


def test_softmax_and_confidence(spark):
    p = one(spark, A.softmax(F.col("z")), z=[1000.0, 999.0, -5.0])
    e = np.exp([0, -1, -1005.0])
    assert np.allclose(p, e / e.sum())
    assert one(spark, A.entropy_confidence(F.col("p")), p=[0.25] * 4) == pytest.approx(0)
    assert one(spark, A.entropy_confidence(F.col("p")), p=[1.0, 0.0]) == pytest.approx(1)
    assert one(spark, A.entropy_confidence(F.col("p")), p=[1.0]) == 0
    assert one(spark, A.argmax(F.col("p")), p=[0.4, 0.4, 0.2]) == 0


def test_rotation_round_trip(spark):
    z = [float(i) for i in range(5)]
    turned = A.unrotate(F.slice(F.concat("z", "z"), 3, 5), F.lit(2))
    assert one(spark, turned, z=z) == z
    assert one(spark, A.rotations(F.lit(5), 4)) == [0, 1, 2, 4]


def test_cumulative_is_a_distribution(spark):
    p = one(spark, A.cumulative_to_levels(F.col("z")), z=[2.0, 3.0, -1.0])
    assert len(p) == 4 and sum(p) == pytest.approx(1) and min(p) > 0


def test_interpolate_clips(spark):
    xs, ys = (F.array(*map(F.lit, v)) for v in ([0.0, 1.0, 3.0], [0.1, 0.5, 0.9]))
    got = [one(spark, A.interpolate(F.lit(float(x)), xs, ys)) for x in (-5, 0, 0.5, 2, 3, 9)]
    assert np.allclose(got, np.interp([-5, 0, 0.5, 2, 3, 9], [0, 1, 3], [0.1, 0.5, 0.9]))


def test_ece_and_selective(spark):
    rows = [(0, i, 0.9, int(i < 9)) for i in range(10)] + [(0, 10 + i, 0.6, int(i < 6)) for i in range(10)]
    df = spark.createDataFrame(rows, "u int, i int, c double, ok int")
    bins = metrics.binned(df, ["u"], "c", "i", 2).groupBy("bin").count().collect()
    assert sorted(r["count"] for r in bins) == [10, 10]
    few = df.filter("i < 7")
    assert metrics.binned(few, ["u"], "c", "i").select("bin").distinct().count() == 7
    s = metrics.selective(df, ["u"], "c", "ok", "i").first()
    assert s["acc_at_50"] == pytest.approx(0.9) and s["acc_at_100"] == pytest.approx(0.75)


def test_auroc_ties_and_single_class(spark):
    df = spark.createDataFrame([(0, 0.9, 1), (0, 0.8, 1), (0, 0.3, 0), (0, 0.8, 0), (1, 0.5, 1)], "u int, s double, y int")
    got = {r["u"]: r["auroc"] for r in metrics.auroc(df, ["u"], "s", "y").collect()}
    assert got[0] == pytest.approx(0.875) and got[1] is None


def test_platt_recovers_parameters(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(0.25 * z - 0.4)))
    df = spark.createDataFrame([("a", float(a), int(b)) for a, b in zip(z, y)], "k string, z double, y int")
    w = fits.fit_logistic(df, "k", ["z"], "y").first()["w"]
    assert w[0] == pytest.approx(0.25, abs=0.05) and w[1] == pytest.approx(-0.4, abs=0.1)


def test_temperature_recovers(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(0, 1, (1500, 5)) * 8
    p = np.exp(z / 4 - (z / 4).max(axis=1, keepdims=True))
    y = [int(rng.choice(5, p=r / r.sum())) for r in p]
    df = spark.createDataFrame([("a", r.tolist(), k) for r, k in zip(z, y)], "k string, z array<double>, y int")
    assert fits.fit_temperature(df, "k", "z", "y").first()["temperature"] == pytest.approx(4, rel=0.15)


def test_go_no_go(spark):
    df = spark.createDataFrame([(0.01, 0.01, 0.0, 100.0), (0.2, None, 0.0, 100.0), (0.01, None, 0.0, 100.0)], "gap double, ece double, failures double, latency_ms double")
    assert [r["verdict"] for r in metrics.go_no_go(df).collect()] == ["GO", "NO-GO", "PARTIAL"]


def test_bootstrap_covers_mean(spark):
    df = spark.createDataFrame([("u", i, i % 4 > 0) for i in range(400)], "u string, i long, ok boolean").withColumn("ok", F.col("ok").cast("int"))
    r = resample.cluster_bootstrap(df, "u", "i", "ok", draws=300).first()
    assert r["low"] < r["mean"] < r["high"] and r["mean"] == pytest.approx(0.75)


def test_text_helpers(spark):
    assert one(spark, X.candidate(F.lit("golden_retriever"), F.lit(""))) == "golden retriever"
    assert one(spark, X.first_allowed(F.lit("Not bad, good"), ["good", "bad"])) == "bad"
    assert one(spark, X.json_answer(F.lit('x {"k": 3} y'), "k")) == 3
    assert one(spark, X.json_answer(F.lit('x {"k": true} y'), "k")) is None
    assert one(spark, X.safe_name(F.lit("a/b ü"))) == "a_b_ü"
    assert one(spark, X.html_escape(F.lit("<a&'>"))) == "&lt;a&amp;&#x27;&gt;"


def test_decide_is_order_free_and_rejects(spark):
    rows = [(1, ["img0"], "q", "choice", ["a", "b", "c"], None), (2, ["img0"], "q", "choice", ["a"], None), (3, ["x", "x"], "q", "noul", [], None), (4, ["img0"], "q", "choice", ["c", "b", "a"], None)]
    df = spark.createDataFrame(rows, "request_id int, images array<string>, question string, type string, keys array<string>, descriptions array<string>")
    bad = {r["request_id"]: len(r["errors"]) for r in decide.problems(df).collect()}
    assert bad == {1: 0, 2: 1, 3: 1, 4: 0}
    got = {r["request_id"]: r for r in decide.decide(df).collect()}
    assert set(got) == {1, 4} and got[1]["answer"] == got[4]["answer"]
    assert got[1]["p"] == pytest.approx(got[4]["p"][::-1])


def test_readers_and_sinks(spark, tmp_path):
    assert readers.jsonl(spark, str(tmp_path / "none"), "a int").count() == 0
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    sinks.append_jsonl(df, str(tmp_path / "j"))
    sinks.append_jsonl(df, str(tmp_path / "j"))
    assert readers.jsonl(spark, str(tmp_path / "j"), "a int, b string").count() == 4
    new = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos int, item string")
    assert [r["item"] for r in sinks.extend_manifest(new, new.filter("pos < 2"), ["item"]).collect()] == ["c"]
    with pytest.raises(Exception, match="manifest differs"):
        sinks.extend_manifest(new, spark.createDataFrame([(0, "z")], "pos int, item string"), ["item"]).collect()
    up = sinks.upsert(df, spark.createDataFrame([(2, "z")], "a int, b string"), "a")
    assert {tuple(r) for r in up.collect()} == {(1, "x"), (2, "z")}
    names = readers.score_names(spark.createDataFrame([("I01_03_05.png",)], "dist_img string")).first()
    assert (names["ref"], names["distortion"], names["level"]) == ("I01", 3, 4)
    (tmp_path / "img" / "2_bad").mkdir(parents=True)
    (tmp_path / "img" / "2_bad" / "a.png").write_bytes(b"x")
    r = readers.level_folders(spark, str(tmp_path / "img")).first()
    assert r["level"] == 2 and r["bytes"] == 1
