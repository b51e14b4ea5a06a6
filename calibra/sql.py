"""The SQL surface: functions, views and table functions for `spark.sql`, registered by one call.

The functions are Spark SQL functions, so Catalyst inlines their bodies and nothing leaves the JVM. They compute what
`functions/arrays.py` does for columns. Each gives null for a null argument, and for a null inside an array it sums over.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions import arrays as A
from calibra.operators import metrics as M

#: name: arguments, type of the result, body. A value that a body names more than once is bound once by a lambda.
FUNCTIONS = {
    "sigmoid": ("z DOUBLE", "DOUBLE", "1 / (1 + exp(-z))"),
    "array_total": ("a ARRAY<DOUBLE>", "DOUBLE", "aggregate(a, 0D, (s, x) -> s + x)"),
    "softmax": (
        "z ARRAY<DOUBLE>, temperature DOUBLE DEFAULT 1D",
        "ARRAY<DOUBLE>",
        """get(transform(array(array_max(z)), m -> get(transform(array(transform(z, x -> exp((x - m) / temperature))),
             e -> get(transform(array(aggregate(e, 0D, (s, x) -> s + x)), t -> transform(e, x -> x / t)), 0)), 0)), 0)""",
    ),
    "logsumexp": ("z ARRAY<DOUBLE>", "DOUBLE", "get(transform(array(array_max(z)), m -> m + ln(aggregate(z, 0D, (s, x) -> s + exp(x - m)))), 0)"),
    "predicted": ("p ARRAY<DOUBLE>", "INT", "CAST(array_position(p, array_max(p)) - 1 AS INT)"),
    "entropy_confidence": (
        "p ARRAY<DOUBLE>",
        "DOUBLE",
        """CASE WHEN p IS NULL THEN NULL WHEN size(p) < 2 THEN 0D ELSE greatest(0D, least(1D,
             1 + aggregate(p, 0D, (s, x) -> s + CASE WHEN x > 0 THEN x * ln(x) ELSE 0D END) / ln(CAST(size(p) AS DOUBLE)))) END""",
    ),
    "margin": ("p ARRAY<DOUBLE>", "DOUBLE", "get(transform(array(sort_array(p, false)), s -> get(s, 0) - get(s, 1)), 0)"),
    "expected_level": ("p ARRAY<DOUBLE>", "DOUBLE", "aggregate(transform(p, (x, i) -> x * i), 0D, (s, x) -> s + x)"),
    "yes_confidence": ("p DOUBLE", "DOUBLE", "2 * abs(p - 0.5D)"),
    "nll": ("p ARRAY<DOUBLE>, y INT", "DOUBLE", "CASE WHEN get(p, y) IS NOT NULL THEN -ln(greatest(get(p, y), 1e-12D)) END"),
    "brier": ("p ARRAY<DOUBLE>, y INT", "DOUBLE", "aggregate(transform(p, (x, i) -> power(x - CASE WHEN i = y THEN 1D ELSE 0D END, 2D)), 0D, (s, x) -> s + x)"),
    "platt": ("z DOUBLE, slope DOUBLE, shift DOUBLE", "DOUBLE", "1 / (1 + exp(-(slope * z + shift)))"),
}
PREFIX = "calibra_"


def register_functions(spark: SparkSession) -> None:
    """Creates every function as `calibra_<name>` in this session; calling it again changes nothing."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({args}) RETURNS {kind} RETURN {body}")


def register(spark: SparkSession, decisions: DataFrame, unit: str, item: str, p: str = "p", y: str = "y", prefix: str = "") -> None:
    """The functions, the views of one table of decisions, and the table functions over them.

    decisions holds a unit, a numeric item id, a probability array p and the index y of the true option.

    View `<prefix>decisions`: unit, item_id, p, y, pred, conf, correct; `<prefix>reliability`: unit, bin, confidence,
    accuracy, n; `<prefix>risk_coverage`: unit, item_id, k, risk. Rows with a null p or y are left out.
    Table functions: `calibra_<prefix>ece()`: unit, n, ece; `calibra_<prefix>coverage_at(max_risk)`: unit, kept, n of the
    widest prefix of the most confident rows whose risk is at most max_risk; `calibra_<prefix>metrics()`: one row a unit
    and one with a null unit for all rows.

    The two orders behind the views are made here, by ranges; what SQL reads later is their Parquet.
    """
    register_functions(spark)
    rows = decisions.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).select(F.col(unit).cast("string").alias("unit"), F.col(item).alias("item_id"), F.col(p).alias("p"), F.col(y).cast("int").alias("y"))
    rows = rows.withColumns({"pred": A.argmax(F.col("p")), "conf": F.round(A.top(F.col("p")), 9)}).withColumn("correct", (F.col("pred") == F.col("y")).cast("int"))
    rows.createOrReplaceTempView(f"{prefix}decisions")
    M.reliability(rows, ["unit"], "conf", "correct", "item_id").createOrReplaceTempView(f"{prefix}reliability")
    M.risk_coverage(rows, ["unit"], "conf", "correct", "item_id").createOrReplaceTempView(f"{prefix}risk_coverage")
    tables = {
        "ece": ("", "unit STRING, n BIGINT, ece DOUBLE", f"SELECT unit, sum(n), sum(n * abs(confidence - accuracy)) / sum(n) FROM {prefix}reliability GROUP BY unit"),
        "coverage_at": (
            "max_risk DOUBLE",
            "unit STRING, kept BIGINT, n BIGINT",
            f"SELECT unit, max(fits), count(*) FROM (SELECT unit, CASE WHEN risk <= max_risk THEN CAST(k AS BIGINT) ELSE 0L END AS fits FROM {prefix}risk_coverage) GROUP BY unit",
        ),
        "metrics": (
            "",
            "unit STRING, n BIGINT, accuracy DOUBLE, nll DOUBLE, brier DOUBLE, mae DOUBLE",
            f"""SELECT unit, count(*), avg(CAST(correct AS DOUBLE)), avg({PREFIX}nll(p, y)), avg({PREFIX}brier(p, y)), avg(abs({PREFIX}expected_level(p) - y))
                FROM {prefix}decisions GROUP BY GROUPING SETS ((unit), ())""",
        ),
    }
    for name, (args, columns, body) in tables.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{prefix}{name}({args}) RETURNS TABLE({columns}) RETURN {body}")
