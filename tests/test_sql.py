"""The SQL functions give what the column functions give; the table functions what the metrics give."""
from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from calibra import sql
from calibra.functions import arrays as A
from calibra.operators import metrics as M

Z = [[0.3, -1.2, 2.5], [0.0, 0.0], [700.0, -700.0, 1.0], [5.0], [-1e-9, 1e-9, 0.25, 0.125]]


@pytest.fixture(scope="module")
def rows(spark):
    sql.register_functions(spark)
    sql.register_functions(spark)  # again changes nothing
    df = spark.createDataFrame([(i, z, i % len(z)) for i, z in enumerate(Z)], "i int, z array<double>, y int").withColumn("p", A.softmax(F.col("z")))
    df.createOrReplaceTempView("sql_rows")
    return df


@pytest.mark.parametrize(
    ("text", "column"),
    [
        ("calibra_softmax(z)", lambda: A.softmax(F.col("z"))),
        ("calibra_softmax(z, 2.5D)", lambda: A.softmax(F.col("z"), 2.5)),
        ("calibra_logsumexp(z)", lambda: A.logsumexp(F.col("z"))),
        ("calibra_predicted(p)", lambda: A.argmax(F.col("p"))),
        ("calibra_entropy_confidence(p)", lambda: A.entropy_confidence(F.col("p"))),
        ("calibra_margin(p)", lambda: A.margin(F.col("p"))),
        ("calibra_expected_level(p)", lambda: A.expected_level(F.col("p"))),
        ("calibra_nll(p, y)", lambda: A.nll(F.col("p"), F.col("y"))),
        ("calibra_brier(p, y)", lambda: A.brier(F.col("p"), F.col("y"))),
        ("calibra_array_total(z)", lambda: A.total(F.col("z"))),
        ("calibra_sigmoid(z[0])", lambda: A.sigmoid(F.col("z")[0])),
        ("calibra_yes_confidence(p[0])", lambda: A.yes_confidence(F.col("p")[0])),
    ],
)
def test_same_as_columns(spark, rows, text, column):
    got = [r[0] for r in spark.sql(f"SELECT {text} FROM sql_rows ORDER BY i").collect()]
    want = [r[0] for r in rows.select("i", column().alias("v")).orderBy("i").select("v").collect()]
    for g, w in zip(got, want, strict=True):
        assert g == (pytest.approx(w, rel=1e-12, abs=1e-15) if w is not None else None)


@pytest.mark.parametrize("text", ["softmax(a)", "logsumexp(a)", "predicted(a)", "entropy_confidence(a)", "margin(a)", "expected_level(a)", "nll(a, 0)", "brier(a, 0)", "sigmoid(a[0])"])
def test_null_gives_null(spark, rows, text):
    assert spark.sql(f"SELECT calibra_{text} FROM (SELECT CAST(NULL AS ARRAY<DOUBLE>) AS a)").first()[0] is None


def test_no_python_in_the_plan(spark, rows):
    plan = spark.sql("SELECT calibra_margin(calibra_softmax(z)) FROM sql_rows")._jdf.queryExecution().toString()
    assert "Python" not in plan and "calibra_" not in plan.split("Optimized Logical Plan")[-1].split("Physical Plan")[-1].replace("calibra_margin(calibra_softmax", "")


def test_table_functions(spark):
    data = [(f"u{i % 3}", i, [(i * 37 % 101 + 1) / 103, 1 - (i * 37 % 101 + 1) / 103], i * i % 2) for i in range(200)] + [("u0", 900, None, 1), ("u1", 901, [0.5, 0.5], None), (None, 902, [0.9, 0.1], 0)]
    df = spark.createDataFrame(data, "u string, id long, p array<double>, y int")
    sql.register(spark, df, "u", "id", prefix="t_")
    good = [(u, i, p, y) for u, i, p, y in data if p is not None and y is not None]
    got = {r["unit"]: r for r in spark.sql("SELECT * FROM calibra_t_ece()").collect()}
    flat = spark.table("t_decisions")
    want = {r["unit"]: r["ece"] for r in M.ece(flat, ["unit"], "conf", "correct", "item_id").collect()}
    assert {u: r["n"] for u, r in got.items()} == {u: sum(g[0] == u for g in good) for u in ("u0", "u1", "u2", None)}
    assert {u: r["ece"] for u, r in got.items()} == pytest.approx(want)
    for limit in (0.0, 0.3, 1.0):
        kept = {r["unit"]: r["kept"] for r in spark.sql(f"SELECT * FROM calibra_t_coverage_at({limit}D)").collect()}
        for u in kept:
            order = sorted((g for g in good if g[0] == u), key=lambda g: (-round(max(g[2]), 9), g[1]))
            wrong, best = 0, 0
            for k, (_, _, p, y) in enumerate(order, 1):
                wrong += p.index(max(p)) != y
                best = k if wrong / k <= limit else best
            assert kept[u] == best
    every = spark.sql("SELECT * FROM calibra_t_metrics() WHERE n = (SELECT count(*) FROM t_decisions)").first()
    assert every["accuracy"] == pytest.approx(sum(p.index(max(p)) == y for _, _, p, y in good) / len(good))
    assert every["nll"] == pytest.approx(sum(-math.log(p[y]) for _, _, p, y in good) / len(good))


def test_empty_table(spark):
    sql.register(spark, spark.createDataFrame([], "u string, id long, p array<double>, y int"), "u", "id", prefix="none_")
    assert spark.sql("SELECT * FROM calibra_none_ece()").count() == 0
