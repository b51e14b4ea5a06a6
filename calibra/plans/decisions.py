"""Requests, statements and answers; sources and sinks."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from calibra.operators import decide as D
from calibra.operators.ranks import running
from calibra.plans._register import Registry
from calibra.sources import paged, readers, sinks, store
from calibra.sources import standins as S
from calibra.sources.scratch import shared_dir
from calibra.streaming import collector

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def requests(spark, sf_dir):
    """A request for each part; some break a rule."""
    p = S.read(spark, sf_dir, "part")
    i = F.col("p_partkey")
    kind = F.when(i % 3 == 0, "noul").when(i % 3 == 1, "choice").when(i % 29 == 0, "rank").otherwise("score")
    keys = F.when(i % 3 == 0, F.array().cast("array<string>")).when(i % 17 == 0, F.array("p_brand")).otherwise(F.array("p_brand", "p_type", F.lit("other")))
    images = F.when(i % 11 == 0, F.array(F.lit("img0"), F.lit("img0"))).otherwise(F.array(F.lit("img0")))
    return p.select(i.alias("request_id"), images.alias("images"), F.concat(F.lit("Is it "), "p_name", F.lit("?")).alias("question"), kind.alias("type"), keys.alias("keys"), F.transform(keys, lambda x: F.lit(None).cast("string")).alias("descriptions"))


_REQ = """req AS (SELECT p_partkey AS i, p_name, p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN 'noul' WHEN p_partkey % 3 = 1 THEN 'choice' WHEN p_partkey % 29 = 0 THEN 'rank' ELSE 'score' END AS type,
  CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 17 = 0 THEN 1 ELSE 3 END AS k FROM part),
good AS (SELECT * FROM req WHERE i % 11 <> 0 AND type <> 'rank' AND (type = 'noul' OR k >= 2))"""
_STATEMENTS = f"""{_REQ}, st AS (SELECT i, type, 0 AS pos, 'Is it ' || p_name || '?' AS statement FROM good WHERE type = 'noul' UNION ALL
  SELECT i, type, unnest([0, 1, 2]), unnest(['Is it ' || p_name || '? ' || replace(p_brand, '_', ' '), 'Is it ' || p_name || '? ' || replace(p_type, '_', ' '), 'Is it ' || p_name || '? other']) FROM good WHERE type <> 'noul'),
z AS (SELECT *, ('0x' || substr(sha256(statement), 1, 8))::BIGINT / 4294967296::DOUBLE * 8 - 4 AS z FROM st)"""


@query(f"WITH {_REQ} SELECT i AS request_id, CAST(i % 11 = 0 AS INT) + CAST(type = 'rank' AS INT) + CAST(type IN ('choice', 'score') AND k < 2 AS INT) AS errors FROM req")
def validate_requests(spark, sf_dir):
    return D.problems(requests(spark, sf_dir)).select("request_id", F.size("errors").alias("errors"))


@query(f"WITH {_STATEMENTS} SELECT i AS request_id, pos, statement FROM st")
def fanout_statements(spark, sf_dir):
    good = D.problems(requests(spark, sf_dir)).filter(F.size("errors") == 0)
    return D.fan_out(good).select("request_id", "pos", "statement")


@query(f"""WITH {_STATEMENTS}, e AS (SELECT *, CASE WHEN type = 'noul' THEN 1 / (1 + exp(-z)) ELSE exp(z - max(z) OVER (PARTITION BY i)) END AS e FROM z),
  p AS (SELECT *, CASE WHEN type = 'noul' THEN e ELSE e / sum(e) OVER (PARTITION BY i) END AS p FROM e)
  SELECT i AS request_id, type, round(max(CASE WHEN type = 'noul' THEN greatest(p, 1 - p) ELSE p END), 6) AS top, round(CASE WHEN type <> 'noul' THEN 1 + sum(p * ln(p)) / ln(3) END, 6) AS confidence FROM p GROUP BY i, type""")
def decide_requests(spark, sf_dir):
    a = D.decide(requests(spark, sf_dir))
    return a.select("request_id", "type", F.round(F.array_max("p"), 6).alias("top"), F.round("confidence", 6).alias("confidence"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2")
def scan_prune(spark, sf_dir):
    rows = S.read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_shipdate").filter("l_shipdate >= timestamp'1995-01-01'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def _folder(spark) -> str:
    """A new folder that all executors see."""
    return f"{shared_dir(spark)}/calibra-{uuid.uuid4().hex}"


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def jsonl_round_trip(spark, sf_dir):
    path = f"{_folder(spark)}/nation-jsonl"
    sinks.append_jsonl(S.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), path, mode="overwrite")
    return readers.jsonl(spark, path, "id int, name string, region int")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_call_log(spark, sf_dir):
    path = f"{_folder(spark)}/calls-{sf_dir.rstrip('/').rsplit('/', 1)[-1]}"
    sinks.daily_log(S.calls(spark, sf_dir), path, mode="overwrite")
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS key_hash, CASE WHEN o_orderstatus = 'F' THEN 'user' ELSE 'shipped' END AS origin FROM orders GROUP BY 1, 2")
def keyed_calibration(spark, sf_dir):
    keys = S.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("key_hash")).distinct()
    shipped = keys.withColumn("origin", F.lit("shipped"))
    return readers.first_by_priority([keys.filter("key_hash = 'F'").withColumn("origin", F.lit("user")), shipped], "key_hash")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS calls, round(sum(value), 2) AS total_ms FROM events GROUP BY 1, 2")
def stream_call_log_daily(spark, sf_dir):
    from calibra.streaming import call_log

    path = f"{_folder(spark)}/stream-{sf_dir.rstrip('/').rsplit('/', 1)[-1]}"
    return call_log.daily_counts(spark, f"{sf_dir}/events.parquet", path).select("day", "event_type", "calls", F.round("total_ms", 2).alias("total_ms"))


_COLLECTED = ", ".join(f"('{m}', {'NULL' if v is None else repr(v)}, '{m if v is None else f'{m}@{v}'}', {i})" for i, (m, v) in enumerate(collector.jobs()))


@query(f"""SELECT o_orderstatus AS ladder, o_orderkey AS item_id, m.key AS method_key, ((o_orderkey * 7919 + m.i * 104729) % 1009) / 1009::DOUBLE AS top
  FROM orders, (VALUES {_COLLECTED}) AS m(method, variant, key, i)""")
def collect_stream(spark, sf_dir):
    """Items that arrive in two parts, read out by a stream that is started for each; its last batch then comes a second time."""
    base = f"{_folder(spark)}"
    items = S.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("ladder"), F.col("o_orderkey").alias("item_id"))
    number = F.element_at(F.create_map(*(F.lit(x) for i, (m, v) in enumerate(collector.jobs()) for x in (m if v is None else f"{m}@{v}", i))), F.col("method_key"))
    readout = lambda rows: rows.withColumn("top", S.noise(F.col("item_id"), number))
    schema = "ladder string, item_id long"
    for part in (0, 1):
        items.filter(F.col("item_id") % 2 == part).repartition(2, "item_id").write.mode("append").parquet(f"{base}/items")
        collector.collect(spark, f"{base}/items", schema, f"{base}/rows", f"{base}/state", readout)
    collector.step(spark, spark.read.parquet(f"{base}/items"), f"{base}/rows", readout, collector.jobs())
    return spark.read.parquet(f"{base}/rows").select("ladder", "item_id", "method_key", "top")


@query("""WITH p AS (SELECT regexp_extract(url, '//(?:[^/]*\\.)?example\\.([a-z]+)/', 1) AS kind, page_id, length(html) AS n FROM pages),
  r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY page_id) AS r FROM p WHERE kind IN ('com', 'net'))
  SELECT kind, CAST((r - 1) // 20 + 1 AS INT) AS page, page_id, n FROM r WHERE r <= 50""")
def paged_source(spark, sf_dir):
    """Saved pages of an API, read through the data source up to a quota for each class; classes that are not asked for are not opened."""
    paged.register(spark)
    path = f"{_folder(spark)}/api"
    kind = F.regexp_extract("url", r"//(?:[^/]*\.)?example\.([a-z]+)/", 1)
    rows = S.read(spark, sf_dir, "pages").select(kind.alias("kind"), "page_id", F.length("html").cast("long").alias("n")).filter("kind <> ''")
    paged.save_pages(running(rows, ["kind"], "page_id", "page_id"), path, "kind", 20)
    asked = spark.read.format("saved_pages").options(path=path, classes="com,net", per_class=50, per_page=20, schema="page_id long, n long").load()
    return asked.select("kind", "page", "page_id", "n")


@query("""SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * CASE WHEN vec_id % 3 = 0 THEN -1 ELSE 1 END, 6) AS first, CAST(len(embedding) AS INT) AS size FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0""")
def hidden_upsert(spark, sf_dir):
    """Vectors written to the bucketed store, then others over some of them and beside them."""
    v = S.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    table = store.KeyedStore(spark, f"{_folder(spark)}/hidden", ["vec_id"])
    table.upsert(v.filter("vec_id % 2 = 0"))
    table.upsert(v.filter("vec_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    return table.read().select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.size("embedding").alias("size"))
