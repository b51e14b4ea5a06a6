"""Row shapes of decisions, readouts and logs, made from the tables of a data folder; each with its SQL twin.

Scores carry whole-number noise, ((id * 7919 + k * 104729 + s * 1299709) % 1009) / 1009, which every engine computes
alike and a shuffle cannot change.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS, LABELS = 5, 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noise(i: Column, k: Column | int, s: int = 0) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return ((i * 7919 + k * 104729 + s * 1299709) % 1009) / F.lit(1009.0)


#: A row and a draw give a number in [0, 1) by squares modulo this prime, which every engine computes alike.
_PRIME = 2147483647


def uniform(i: Column, draw: Column) -> Column:
    x = (i * 48271 + draw * 69621 + 12345) % _PRIME
    for k in (1, 2, 3):
        x = (x * x + draw * (7919 * k) + i) % _PRIME
    return x / F.lit(float(_PRIME))


def uniform_sql(i: str, draw: str) -> str:
    x = f"(({i} * 48271 + {draw} * 69621 + 12345) % {_PRIME})"
    for k in (1, 2, 3):
        x = f"(({x} * {x} + {draw} * {7919 * k} + {i}) % {_PRIME})"
    return f"{x} / {float(_PRIME)}::DOUBLE"


def scores(spark: SparkSession, sf_dir: str, s: int = 0) -> DataFrame:
    """item_id, grp, y, split, z: ratings on five levels."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("grp"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("y"))
    z = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.abs(k - F.col("y")) * F.lit(-0.8) + noise(F.col("item_id"), k, s) * 4)
    return o.withColumn("split", F.when(F.col("item_id") % 2 == 0, "calibration").otherwise("test")).withColumn("z", z)


def _scores_sql(name: str, s: int) -> str:
    return f"""{name} AS (SELECT item_id, grp, y, CASE WHEN item_id % 2 = 0 THEN 'calibration' ELSE 'test' END AS split,
  list_transform([0, 1, 2, 3, 4], lambda k: abs(k - y) * (-0.8::DOUBLE) + ((item_id * 7919 + k * 104729 + {s} * 1299709) % 1009) / 1009::DOUBLE * 4) AS z
  FROM (SELECT o_orderkey AS item_id, o_orderstatus AS grp, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS y FROM orders))"""


SCORES = _scores_sql("scores", 0)
SCORES1 = _scores_sql("scores1", 1)
#: Softmax of the scores, with prediction and confidence.
PROBS = (
    SCORES
    + """, probs AS (SELECT *, list_position(p, list_max(p)) - 1 AS pred, list_max(p) AS conf, CAST(list_position(p, list_max(p)) - 1 = y AS INT) AS correct FROM (
  SELECT item_id, grp, y, split, z, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (
    SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM scores)))"""
)


def nouls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, grp, y (0, 1), split, z: yes/no decisions."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    z = (2 * F.col("quality") - 1) * F.lit(0.7) + noise(F.col("doc_id"), 0) * 4 - 2
    return rows.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("grp"), F.col("quality").alias("y"), F.when(F.col("doc_id") % 2 == 0, "calibration").otherwise("test").alias("split"), z.alias("z"))


NOULS = """nouls AS (SELECT l.doc_id AS item_id, d.lang AS grp, l.quality AS y, CASE WHEN l.doc_id % 2 = 0 THEN 'calibration' ELSE 'test' END AS split,
  (2 * l.quality - 1) * 0.7::DOUBLE + ((l.doc_id * 7919) % 1009) / 1009::DOUBLE * 4 - 2 AS z FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def readouts(spark: SparkSession, sf_dir: str, members: int = 4) -> DataFrame:
    """ladder, item_id, method_key, y, z, latency_ms: the long table of a collector; some rows are missing."""
    base = scores(spark, sf_dir).select(F.col("grp").alias("ladder"), "item_id", "y")
    rows = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("m"))
    z = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.abs(k - F.col("y")) * F.lit(-0.8) + ((F.col("item_id") * 7919 + k * 104729 + F.col("m") * 1299709) % 1009) / F.lit(1009.0) * 4)
    made = rows.select("ladder", "item_id", F.concat(F.lit("m"), F.col("m").cast("string")).alias("method_key"), "y", z.alias("z"), (100 + (F.col("item_id") * 31 + F.col("m") * 17) % 211).cast("double").alias("latency_ms"))
    return made.filter((F.col("item_id") + F.substring("method_key", 2, 1).cast("int")) % 13 != 0)


READOUTS = """readouts AS (SELECT ladder, item_id, 'm' || m AS method_key, y,
  list_transform([0, 1, 2, 3, 4], lambda k: abs(k - y) * (-0.8::DOUBLE) + ((item_id * 7919 + k * 104729 + m * 1299709) % 1009) / 1009::DOUBLE * 4) AS z,
  CAST(100 + (item_id * 31 + m * 17) % 211 AS DOUBLE) AS latency_ms
  FROM (SELECT o_orderstatus AS ladder, o_orderkey AS item_id, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS y, unnest([0, 1, 2, 3]) AS m FROM orders)
  WHERE (item_id + m) % 13 <> 0)"""


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, system, correct: answers of three systems; each leaves some items out."""
    o = scores(spark, sf_dir).select("item_id", "grp", F.explode(F.array(*map(F.lit, "abc"))).alias("system"), "y")
    s = F.ascii("system") - 97
    return o.filter((F.col("item_id") * 3 + s * 5) % 11 != 0).select("item_id", "grp", "system", ((F.col("item_id") * 7919 + s * 104729) % 1009 < 700 + s * 60).alias("correct"))


SYSTEMS = """systems AS (SELECT item_id, grp, system, (item_id * 7919 + (ascii(system) - 97) * 104729) % 1009 < 700 + (ascii(system) - 97) * 60 AS correct
  FROM (SELECT o_orderkey AS item_id, o_orderstatus AS grp, unnest(['a', 'b', 'c']) AS system FROM orders) WHERE (item_id * 3 + (ascii(system) - 97) * 5) % 11 <> 0)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, user_id, event_type, latency_ms, tokens: a call log."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type", F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))


CALLS = "calls AS (SELECT event_id, ts, user_id, event_type, value AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events)"
