"""Prompts, written answers, identifiers and logs."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from calibra.functions import text as X
from calibra.plans._register import Registry
from calibra.sources import standins as S

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def prompt_hash(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", X.prompt_hash(F.col("text")).alias("hash"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 AND length(p_type) > 0 THEN p_type ELSE replace(replace(p_name, ' ', '_'), '_', ' ') END AS candidate FROM part")
def candidate_text(spark, sf_dir):
    d = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 1, F.lit(""))
    return S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.candidate(F.replace("p_name", F.lit(" "), F.lit("_")), d).alias("candidate"))


@query("SELECT p_partkey AS id, 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. other' AS lettered, '2: other' || chr(10) || '1: ' || p_type || chr(10) || '0: ' || p_brand AS scale FROM part")
def rating_prompts(spark, sf_dir):
    o = F.array("p_brand", "p_type", F.lit("other"))
    return S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.lettered(o).alias("lettered"), X.scale(o, backwards=True).alias("scale"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'img0' WHEN turn % 3 = 1 THEN NULL ELSE 'img1' END AS image FROM conversations")
def regex_image_ids(spark, sf_dir):
    t = F.col("turn") % 3
    asked = F.when(t == 0, F.lit("About `img0`: is `img0` sharp, not `img9`?")).when(t == 1, F.lit("Which of `img0` and `img1`?")).otherwise(F.lit("Look at `img1`."))
    return S.read(spark, sf_dir, "conversations").select("conv_id", "turn", X.referenced_image(asked, F.array(F.lit("img0"), F.lit("img1"))).alias("image"))


@query(r"""WITH p AS (SELECT doc_id, regexp_extract(lower(text), '(?:^|[^\p{L}\p{N}_])(the|and|der|que)(?:$|[^\p{L}\p{N}_])', 1) AS w FROM documents) SELECT doc_id, nullif(w, '') AS answer FROM p""")
def lenient_answer(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", X.first_allowed(F.col("text"), ["the", "and", "der", "que"]).alias("answer"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def parse_json_answer(spark, sf_dir):
    body = F.when(F.col("event_id") % 4 == 3, F.lit('{"k": true}')).otherwise(F.col("props"))
    return S.read(spark, sf_dir, "events").select("event_id", X.json_answer(F.concat(F.lit("Sure:\n"), body, F.lit(" done")), "k").alias("k"))


@query(r"""SELECT doc_id, length(scrubbed) AS n, md5(scrubbed) AS digest FROM (SELECT doc_id, regexp_replace(text || ' sk-' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) || ' AIza' || substr(md5(text), 1, 12) || ' key.a*' || substr(md5(text), 1, 8) || ' end', '(sk|key|AIza)[-_A-Za-z0-9*.]{8,}', '<api-key>', 'g') AS scrubbed FROM documents)""")
def scrub_keys(spark, sf_dir):
    part = lambda c, n: F.substring(F.md5(c.cast("binary")), 1, n)
    dirty = F.concat("text", F.lit(" sk-"), part(F.col("doc_id").cast("string"), 12), F.lit(" AIza"), part(F.col("text"), 12), F.lit(" key.a*"), part(F.col("text"), 8), F.lit(" end"))
    rows = S.read(spark, sf_dir, "documents").select("doc_id", X.scrub(dirty).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}._-]', '_', 'g') AS name FROM pages")
def safe_name(spark, sf_dir):
    return S.read(spark, sf_dir, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"))


@query(r"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '/medium.jpg' END AS url FROM pages")
def url_rewrite(spark, sf_dir):
    u = F.concat("url", F.when(F.col("page_id") % 2 == 0, F.lit("/square.jpg")).otherwise(F.lit("/large.jpg")))
    return S.read(spark, sf_dir, "pages").select("page_id", F.when(u.rlike(r"/square\.[a-z]+$"), F.regexp_replace(u, r"/square\.([a-z]+)$", "/medium.$1")).alias("url"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, strftime(min(ts), '%Y%m%dT%H%M%SZ') AS first_call, strftime(min(ts), '%Y%m%dT%H%M%SZ') || '-' || substr(sha256(CAST(count(*) AS VARCHAR)), 1, 6) AS run_id, count(*) AS calls FROM events GROUP BY CAST(ts AS DATE)")
def day_partition(spark, sf_dir):
    d = S.read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.min("ts").alias("t"), F.count("*").alias("calls"))
    return d.select("day", F.date_format("t", "yyyyMMdd'T'HHmmss'Z'").alias("first_call"), X.run_id(F.col("t"), F.col("calls").cast("string")).alias("run_id"), "calls")


@query("SELECT event_id FROM (SELECT event_id, ts, user_id, event_type FROM events WHERE event_type = 'purchase' AND value > 20 AND ts >= (SELECT min(ts) FROM events)) QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1")
def observation_filter(spark, sf_dir):
    e = S.read(spark, sf_dir, "events").filter("event_type = 'purchase' and value > 20")
    return e.withColumn("r", F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id"))).filter("r = 1").select("event_id")


@query("SELECT doc_id, source AS kind, CAST(substr(source, 4) AS BIGINT) AS number FROM documents")
def id_parsing(spark, sf_dir):
    made = F.concat("source", F.lit("__"), F.col("doc_id").cast("string"), F.lit("_h"))
    kind = F.split_part(F.regexp_replace(made, "_[hv]$", ""), F.lit("__"), F.lit(1))
    return S.read(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.expr("try_cast(substr(source, 4) as bigint)").alias("number"))


@query("SELECT page_id, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS n FROM pages")
def html_escape(spark, sf_dir):
    return S.read(spark, sf_dir, "pages").select("page_id", F.length(X.html_escape(F.col("html"))).cast("long").alias("n"))


@query(r"""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]+\.[0-9]+', 0)) AS number FROM documents WHERE doc_id % 2 = 0), s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]+\.[0-9]+', 0)) AS number FROM documents WHERE doc_id % 2 = 1)
  SELECT number FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.number = n.number)""")
def docs_number_check(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents")
    numbers = lambda k: d.filter(F.col("doc_id") % 2 == k).select(F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0))).alias("number")).distinct()
    return numbers(0).join(numbers(1), "number", "left_anti")


@query("SELECT role, count(*) AS n, avg(length(text)) AS mean_chars, count(*) FILTER (length(text) = 0) AS blank FROM conversations GROUP BY role")
def written_answers(spark, sf_dir):
    return S.read(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("mean_chars"), F.count_if(F.length("text") == 0).alias("blank"))
