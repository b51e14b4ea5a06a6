"""The bucketed store, the collector and the paged source."""
from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from calibra.operators.ranks import running
from calibra.sources import paged, store
from calibra.streaming import collector


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{root}/data") for f in fs if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    made = lambda data: spark.createDataFrame(data, "k long, v array<float>")
    t = store.KeyedStore(spark, str(tmp_path), ["k"], 8)
    with pytest.raises(FileNotFoundError):
        t.read()
    first = [(i, [float(i)]) for i in range(200)] + [(None, [0.0])]
    assert t.upsert(made(first)) == 1 and rows(t.read()) == rows(made(first))
    before = files(tmp_path)
    assert t.upsert(made([(5, [-5.0]), (5, [-5.0]), (1000, [1.0]), (None, [9.0])])) == 2
    want = {k: v for k, v in first} | {5: [-5.0], 1000: [1.0], None: [9.0]}
    assert {r["k"]: r["v"] for r in t.read().collect()} == want and t.read().count() == 202
    assert rows(t.read(1)) == rows(made(first))  # the old state is still there
    after = files(tmp_path)
    assert all(after[f] == at for f, at in before.items())
    was, now = (t._state(v)["where"] for v in (1, 2))
    touched = {r[0] for r in made([(5, None), (1000, None), (None, None)]).select(t._bucket()).collect()}
    assert {b for b in now if now[b] != was.get(b)} == set(map(str, touched)) and len(touched) < 8
    again = store.KeyedStore(spark, str(tmp_path), ["k"], 99)
    assert again.buckets == 8 and again.read().count() == 202
    t.vacuum()
    assert rows(again.read()) == rows(t.read(2)) and len(files(tmp_path)) < len(after)
    with pytest.raises(ValueError, match="table has"):
        t.upsert(spark.createDataFrame([(1, "x")], "k long, v string"))


def test_an_unfinished_or_second_write_changes_nothing(spark, tmp_path, monkeypatch):
    t = store.KeyedStore(spark, str(tmp_path), ["k"], 4)
    t.upsert(spark.createDataFrame([(1, "a")], "k int, v string"))
    with monkeypatch.context() as m:
        m.setattr(store.KeyedStore, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            t.upsert(spark.createDataFrame([(1, "lost")], "k int, v string"))
    assert rows(t.read()) == [(1, "a")]
    late = t._state(1)
    t.upsert(spark.createDataFrame([(2, "b")], "k int, v string"))
    with pytest.raises(store.Conflict):
        t._commit(2, late)
    assert rows(t.read()) == [(1, "a"), (2, "b")]


def test_collector_resumes_without_double_rows(spark, tmp_path):
    source, target, state = (f"{tmp_path}/{n}" for n in ("items", "rows", "state"))
    for part in range(3):
        spark.createDataFrame([("blur", i) for i in range(part * 10, part * 10 + 10)] + [("blur", 0)], "ladder string, item_id long").coalesce(1).write.mode("append").parquet(source)
    asked = []

    def readout(todo, fail_at=None):
        n = todo.count()
        asked.append(n)
        if len(asked) == fail_at:
            raise RuntimeError("killed")
        return todo.withColumn("z", F.col("item_id") * 2)

    every = collector.jobs()
    assert [k for _, k in every] == [None, None, None, "0:123", "0:123"]
    with pytest.raises(Exception, match="killed"):
        collector.collect(spark, source, "ladder string, item_id long", target, state, lambda t: readout(t, 2))
    assert spark.read.parquet(target).count() == 50
    collector.collect(spark, source, "ladder string, item_id long", target, state, readout)
    got = spark.read.parquet(target)
    assert got.count() == 150 == got.select("ladder", "item_id", "method_key").distinct().count() and sum(asked) == 200
    collector.step(spark, spark.read.parquet(source), target, readout, every)
    assert spark.read.parquet(target).count() == 150 and asked[-1] == 0
    more = collector.jobs(("digits", "zoom_digits", "anchors_digits"), ("c", "tl"), ("0:123", "1:012"))
    assert [f"{m}@{v}" if v else m for m, v in more] == ["digits", "zoom_digits", "zoom_digits@pos:tl", "anchors_digits@0:123", "anchors_digits@1:012"]


def test_collector_shuffles_a_row_for_each_item_only(spark, tmp_path, capsys):
    """F8: two joins and a deduplication dealt every row of every method anew, and rows without an item came again."""
    target, every = f"{tmp_path}/rows", collector.jobs()
    items = spark.createDataFrame([("blur", 1, "a"), ("blur", 1, "a"), ("blur", None, "b"), (None, 2, "c")], "ladder string, item_id long, text string")
    plans = []

    def readout(todo):
        made = todo.withColumn("z", F.length("text"))
        made.dropDuplicates(collector.KEYS).explain()
        plans.append(capsys.readouterr().out)
        return made.unionByName(made)

    collector.step(spark, items.filter("item_id = 1"), target, readout, every[:2])
    for _ in range(2):
        collector.step(spark, items, target, readout, every)
    got = spark.read.parquet(target)
    assert got.count() == 3 * len(every) == got.select(*collector.KEYS).distinct().count() == got.filter("text is not null and z = 1").count()
    assert [p.count("Exchange") for p in plans] == [1, 1, 1] and not any("Join" in p for p in plans)


def test_collector_with_more_methods_than_a_mask_holds(spark, tmp_path):
    target, every = f"{tmp_path}/rows", [("m", str(i)) for i in range(130)]
    items, asked = spark.range(3).selectExpr("'u' AS ladder", "id AS item_id"), []

    def readout(todo):
        asked.append(todo.count())
        return todo

    for methods in (every[::3], every, every):
        collector.step(spark, items, target, readout, methods)
    assert asked == [3 * 44, 3 * 86, 0] and spark.read.parquet(target).select(*collector.KEYS).distinct().count() == 390


def test_patience():
    pauses, answers = [], iter([paged.Answer(429, "", 7), paged.Answer(503, ""), paged.Answer(503, ""), paged.Answer(200, "[]")])
    assert paged.patient(lambda: next(answers), pause=pauses.append) == "[]" and pauses == [7, 4, 8]
    with pytest.raises(paged.Refused, match="404"):
        paged.patient(lambda: paged.Answer(404, ""), pause=pauses.append)
    pauses.clear()
    with pytest.raises(paged.Refused, match="500"):
        paged.patient(lambda: paged.Answer(500, ""), 3, pause=pauses.append)
    assert pauses == [2, 4]


@pytest.fixture
def saved(spark, tmp_path):
    items = spark.createDataFrame([(k, i, f"t{i}") for k, n in (("bird", 25), ("fish", 10), ("moss", 3)) for i in range(n)], "kind string, id long, text string")
    paged.save_pages(running(items, ["kind"], "id", "id"), f"{tmp_path}/api", "kind", 10)
    paged.register(spark)
    return f"{tmp_path}/api"


def test_pages_up_to_the_quota(spark, saved):
    read = lambda **o: spark.read.format("saved_pages").options(path=saved, per_page=10, schema="id long, text string, gone string", **o).load()
    assert rows(read(classes="bird,moss,none", per_class=12)) == sorted([("bird", 1 + i // 10, i, f"t{i}", None) for i in range(12)] + [("moss", 1, i, f"t{i}", None) for i in range(3)], key=repr)
    assert read(classes="bird,fish,moss").count() == 38
    os.makedirs(f"{saved}/kind=broken/page=1")
    with open(f"{saved}/kind=broken/page=1/x.json", "w") as f:
        f.write("not json")
    with pytest.raises(Exception, match="JSON"):
        read(classes="bird,broken").count()
    some = read(classes="bird,broken,fish").filter("kind in ('bird', 'fish') and id > 3")
    assert some.count() == 27 and some.rdd.getNumPartitions() == 2  # the broken class is not opened


def test_pages_as_a_stream(spark, saved, tmp_path):
    """A second start goes on behind the last full page."""
    def run():
        s = spark.readStream.format("saved_pages").options(path=saved, per_page=10, classes="bird,fish", schema="id long, text string").load()
        s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start().awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out")

    assert run().count() == 30
    with open(f"{saved}/kind=bird/page=3/more.txt", "w") as f:
        f.write("\n".join(json.dumps({"id": i, "text": f"t{i}"}) for i in range(25, 30)))
    got = run()
    assert got.filter("kind = 'bird'").count() == 30 and got.select("kind", "id").distinct().count() == 40
