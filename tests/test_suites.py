from __future__ import annotations

import io
import json

import pytest
from pyspark.sql import functions as F

from calibra import config, facade
from calibra.operators import suites


def test_yes_no(spark):
    rows = spark.createDataFrame([(i, f"Is there a cat{i} in the image?", "yes" if i % 2 else "No ") for i in range(20)], "item_id int, text string, answer string")
    got = suites.yes_no_objects(rows).collect()
    assert {r["question"] for r in got} == {f"There is a cat{i} in the image." for i in range(20)} and sum(r["label"] == "true" for r in got) == 10
    assert sum(r["split"] == "calibration" for r in got) == 10
    assert len(suites.yes_no_objects(rows, 6).collect()) == 6
    assert {r["item_id"] for r in suites.yes_no_objects(rows, 6).collect()} <= {r["item_id"] for r in suites.yes_no_objects(rows, 9).collect()}
    with pytest.raises(Exception, match="not understood"):
        suites.yes_no_objects(rows.withColumn("text", F.lit("what"))).collect()
    inj = suites.injection(rows, 4)
    assert inj.count() == 8 and inj.filter("label = 'true'").count() == 0
    assert suites.yes_no_scenes(rows.withColumn("answer", F.when(F.col("item_id") < 5, "maybe").otherwise("yes"))).count() == 15


def test_choices(spark):
    rows = spark.createDataFrame([(i, f"c{i % 30}" if i else "background") for i in range(90)], "item_id int, label string")
    items = suites.many_options(rows)
    assert items.count() == 89 and len(items.first()["keys"]) == 30
    letters = suites.letter_subset(items).collect()
    assert all(len(r["keys"]) == 26 and r["label"] in r["keys"] and r["keys"] == sorted(r["keys"]) for r in letters)
    opened = suites.open_set(items.select("item_id", "keys", "label")).collect()
    assert all(len(r["keys"]) == 24 and r["label"] in r["keys"] for r in opened)
    recast = suites.own_or_other(rows.filter("item_id < 10"), [f"c{i}" for i in range(30)])
    assert recast.count() == 20 and recast.filter("label = 'true'").count() == 10
    assert suites.tail(rows, 50).count() == 40


def test_others(spark):
    gold = spark.createDataFrame([(1, "q", ["a", "b"], "a", {"x": "a", "y": "b"}), (2, "q", ["a", "b"], "a", {"x": "a"})], "item_id int, question string, keys array<string>, label string, annotators map<string,string>")
    assert {r["item_id"]: r["disagreement"] for r in suites.human_gold(gold).collect()} == {"1": 0.5, "2": None}
    screens = spark.createDataFrame([(f"s{i}", {"signed_in": i > 2, "error_shown": False, "checkbox_checked": True}, "Terms" if i % 2 else None) for i in range(10)], "screen_id string, states map<string,boolean>, checkbox_label string")
    states = suites.ui_state(screens).collect()
    assert len(states) == 20 and sum(r["label"] == "true" for r in states) == 9  # two screens have neither sign-in nor checkbox; the others make up for them
    assert {r["question"] for r in states if "checkbox" in r["item_id"]} <= {'Is the "Terms" checkbox checked in `img0`?'}
    assert suites.REGISTRY["probe_count"](spark.createDataFrame([(1, "3")], "item_id int, label string")).first()["label"] == "3"
    assert suites.build("doc_types", gold)[0].startswith("skipped")
    s = spark.createDataFrame([("a", "choice", False), ("b", "noul", True)], "suite string, type string, private boolean")
    b = spark.createDataFrame([("local", True, False, True), ("hosted", False, True, False)], "backend string, letters boolean, hosted boolean, allow_private boolean")
    got = {tuple(r) for r in suites.plan(s, b).collect()}
    assert got == {("a", "local", "independent", "all"), ("a", "local", "letter", "all"), ("a", "hosted", "independent", "test"), ("b", "local", "independent", "all")}


def test_config():
    c = config.override(config.Config(), {"limits": {"images": 2}})
    assert c.limits.images == 2 and c.limits.options == 128
    with pytest.raises(KeyError):
        config.override(c, {"limits": {"nope": 1}})
    assert config.env_file("A='x y'\nexport B=2\nC=3", ["A", "B"]) == {"A": "x y", "B": "2"}
    assert config.combine_spec("e=a+b:mean") == ("e", ["a", "b"], "mean")
    with pytest.raises(ValueError):
        config.combine_spec("e=a+b")
    cut = config.trim_hours({"a": 10.0, "b": 1.0}, {"a": 1000, "b": 1000}, 1.0)
    assert cut["b"] == 1000 and cut["a"] % 2 == 0 and cut["a"] * 10 + 1000 <= 3600


def test_facade(spark, tmp_path):
    d = facade.Decider(spark)
    assert 0 < d.noul("img0", "It is sharp.") < 1
    r = d.choice("img0", "Which?", {"a": None, "b": "the second"})
    assert r["answer"] in ("a", "b") and sum(r["p"]) == pytest.approx(1)
    with pytest.raises(Exception, match="2 to 128 options"):
        d.choice("img0", "Which?", {"a": None})
    fitted = d.fit(spark.createDataFrame([([0.0, 4.0], i % 2) for i in range(20)], "z array<double>, y int"))
    assert fitted.temperature > 10
    (tmp_path / "r.jsonl").write_text(json.dumps({"request_id": 5, "images": ["i"], "question": "q", "type": "score", "keys": ["lo", "hi"]}))
    out = io.StringIO()
    assert facade.main(["decide", str(tmp_path / "r.jsonl")], out) == 0 and json.loads(out.getvalue())["request_id"] == 5
    assert facade.main(["doctor", "--ram-gb", "64"], out) == 0


def test_facade_calibrates_by_configuration(spark, tmp_path):
    rows = [{"key": "k", "suite": "ab"[i % 2], "type": "score", "split": "calibration", "item_id": str(i), "z": [0.0, 3.0], "label_index": int(i % 4 > 0)} for i in range(40)]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)))
    out = io.StringIO()
    assert facade.main(["fit", str(tmp_path / "p.jsonl")], out) == 0
    fitted = [json.loads(x) for x in out.getvalue().splitlines()]
    assert {(r["scope"], r["name"]) for r in fitted} == {("type", "score"), ("suite", "a"), ("suite", "b")} and all(r["nll_after"] <= r["nll_before"] + 1e-9 for r in fitted)
    df = spark.createDataFrame([("k", "a", "score", [0.0, 3.0]), ("other", "a", "score", [0.0, 3.0])], "key string, suite string, type string, z array<double>")
    d = facade.Decider(spark).calibrate(spark.read.schema(facade._ROWS).json(str(tmp_path / "p.jsonl")))
    assert d.calibrated(df.filter("key = 'k'")).first()["p"][1] == pytest.approx(0.75, abs=0.02)
    with pytest.raises(Exception, match="calibration_mismatch"):
        d.calibrated(df).collect()
    with pytest.raises(PermissionError):
        facade.hosted(config.Config(), "x")
    assert facade.main(["suites"], out) == 0


def test_open_set_of_shared_keys(spark):
    """Keys that all rows share are hashed once: the same items as of rows that carry their keys, one pass of ranks instead of two."""
    rows = spark.range(300).selectExpr("id AS item_id", "concat('k', id % 12) AS label")
    kept, names = suites.options(rows, "k3")
    carried = suites.many_options(rows, drop="k3").select("item_id", "keys", "label")
    show = lambda d: sorted(map(str, d.collect()))
    got = show(suites.open_set_of(kept, names))
    assert len(got) == 275 and got == show(suites.open_set(carried))
    assert sum("label='other'" in r for r in got) == 7 * 25
