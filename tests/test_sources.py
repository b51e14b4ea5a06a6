"""Readers and sinks on files of their own."""
from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from calibra.functions import text as X
from calibra.sources import readers, sinks


def test_label_names_of_a_footer(spark, tmp_path):
    meta = {"huggingface": json.dumps({"info": {"features": {"label": {"names": ["cat", "dog"]}}}})}
    pq.write_table(pa.table({"label": [0, 1]}).replace_schema_metadata(meta), tmp_path / "a.parquet")
    assert [tuple(r) for r in readers.label_names(spark, f"{tmp_path}/a.parquet").collect()] == [(0, "cat"), (1, "dog")]
    assert readers.label_names(spark, str(tmp_path)).count() == 2
    with pytest.raises(ValueError):
        readers.label_names(spark, f"{tmp_path}/a.parquet", "breed")


def test_hidden_states(spark, tmp_path):
    x = np.arange(6, dtype=np.float16).reshape(3, 2)
    np.savez(tmp_path / "s.npz", item_ids=np.array(["a", "b", "c"]), hidden=x)
    got = readers.hidden_states(spark, str(tmp_path)).orderBy("item_id").collect()
    assert [(r["item_id"], r["hidden"]) for r in got] == [("a", [0, 1]), ("b", [2, 3]), ("c", [4, 5])]


def test_run_directory_and_snapshot(spark, tmp_path):
    rows = spark.createDataFrame([(1, "/root/x/a.png")], "i int, path string")
    sinks.run_directory(f"{tmp_path}/run", {"predictions": rows, "metrics": rows}, {"b": 1, "a": 2})
    assert spark.read.json(f"{tmp_path}/run/predictions").count() == 1 == spark.read.parquet(f"{tmp_path}/run/metrics").count()
    assert spark.read.text(f"{tmp_path}/run/config").first()[0] == '{"a": 2, "b": 1}'
    sinks.snapshot(rows, f"{tmp_path}/copy", "/root/x/", "path")
    assert spark.read.text(f"{tmp_path}/copy").first()[0] == "a.png"


def test_scrub_takes_keys_of_any_shape(spark):
    for dirty, clean in (("AIzaSyD4x_y-12345 end", "<api-key> end"), ("sk-ab.cd*efgh12 end", "<api-key> end"), ("key=abc", "key=abc"), ("mysecret here", "<api-key> here")):
        assert spark.range(1).select(X.scrub(F.lit(dirty), "mysecret")).first()[0] == clean


def test_canonical_json_and_ids(spark):
    want = json.dumps({"b": None, "a": "é\"\U0001F600", "c": 3}, sort_keys=True)
    df = spark.createDataFrame([("é\"\U0001F600", 3)], "a string, c int")
    fields = {"c": F.col("c"), "a": F.col("a"), "b": F.lit(None).cast("string")}
    assert df.select(X.canonical_json(fields, True)).first()[0] == want
    assert df.select(X.canonical_json(fields)).first()[0] == json.dumps({"b": None, "a": "é\"\U0001F600", "c": 3}, sort_keys=True, ensure_ascii=False)
    ids = [r[0] for r in spark.range(50).select(X.request_id(F.col("id") + 1_700_000_000_000)).collect()]
    assert ids == sorted(ids) and len(set(ids)) == 50 and all(len(i) == 30 for i in ids)
