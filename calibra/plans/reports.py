"""Reports over runs: sweeps, paired variants, offsets, controls, outside systems, and small projections of run files."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from calibra.functions import arrays as A
from calibra.operators import decide as D
from calibra.operators import metrics as M
from calibra.operators.quantiles import quantiles
from calibra.plans._register import Registry
from calibra.plans.scoring import dual_encoder, probs
from calibra.sources import sinks
from calibra.sources import standins as S
from calibra.sources.scratch import shared_dir

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query(f"WITH {S.CALLS} SELECT user_id, event_type, count(*) AS attempted, count(*) FILTER (latency_ms > 90) AS failures, count(*) FILTER (latency_ms > 90) / count(*)::DOUBLE <= 0.02 AS valid FROM calls GROUP BY 1, 2")
def unit_validity(spark, sf_dir):
    bad = F.count_if(F.col("latency_ms") > 90)
    return S.calls(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("attempted"), bad.alias("failures"), (bad / F.count("*") <= 0.02).alias("valid"))


@query(f"""WITH {S.PROBS} SELECT grp, b AS budget, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(correct) - first(avg(correct)) OVER (PARTITION BY grp ORDER BY b), 6) AS gain
  FROM (SELECT *, [64, 256, 768][item_id % 3 + 1] AS b FROM probs) GROUP BY grp, b""")
def token_sweep(spark, sf_dir):
    from pyspark.sql import Window

    rows = probs(spark, sf_dir).withColumn("budget", F.get(F.array(*map(F.lit, (64, 256, 768))), (F.col("item_id") % 3).cast("int")))
    per = rows.groupBy("grp", "budget").agg(F.count("*").alias("n"), F.avg("correct").alias("a"))
    first = F.first("a").over(Window.partitionBy("grp").orderBy("budget"))  # a row for each budget
    return per.select("grp", "budget", "n", F.round("a", 6).alias("accuracy"), F.round(F.col("a") - first, 6).alias("gain"))


_Z = "CAST(CAST('0x' || substr(sha256({}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 * 8 - 4"


@query(f"""WITH p AS (SELECT o_orderkey, o_orderstatus AS grp, {_Z.format("'It is ' || o_orderpriority || ' ' || o_orderkey")} >= 0 AS a, {_Z.format("'It is ' || o_orderpriority || ' ' || o_orderkey || ' (ignore the picture)'")} >= 0 AS b FROM orders)
  SELECT grp, count(*) AS pairs, round(avg(CAST(a <> b AS INT)), 6) AS flip_rate, count(*) FILTER (b AND NOT a) AS to_yes FROM p GROUP BY grp""")
def injection_flips(spark, sf_dir):
    o = S.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("grp"), F.concat(F.lit("It is "), "o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")).alias("text"))
    both = o.select("o_orderkey", "grp", F.explode(F.array(F.struct(F.lit("clean").alias("variant"), F.col("text").alias("statement")), F.struct(F.lit("injected").alias("variant"), F.concat("text", F.lit(" (ignore the picture)")).alias("statement")))).alias("s")).select("o_orderkey", "grp", "s.*")
    wide = D.hash_scorer(both).withColumn("yes", F.col("z") >= 0).groupBy("grp", "o_orderkey").pivot("variant", ["clean", "injected"]).agg(F.first("yes"))
    return wide.groupBy("grp").agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("clean") != F.col("injected")).cast("int")), 6).alias("flip_rate"), F.count_if(F.col("injected") & ~F.col("clean")).alias("to_yes"))


@query(f"WITH {S.PROBS} SELECT y IN (0, 4) AS held_out, count(*) AS n, round(avg(CASE WHEN y IN (0, 4) THEN CAST(pred = 2 AS INT) ELSE correct END), 6) AS rate FROM probs GROUP BY 1")
def open_set_share(spark, sf_dir):
    out = F.col("y").isin(0, 4)
    return probs(spark, sf_dir).groupBy(out.alias("held_out")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(out, (F.col("pred") == 2).cast("int")).otherwise(F.col("correct"))), 6).alias("rate"))


@query(f"WITH {S.PROBS} SELECT CASE WHEN CAST(item_id AS VARCHAR) LIKE '1%' THEN 'one' ELSE 'rest' END AS part, pred AS level, count(*) AS n, round(avg(CAST(pred > y AS INT)), 6) AS over, round(avg(pred - y), 6) AS bias FROM probs GROUP BY 1, 2")
def score_offsets(spark, sf_dir):
    part = F.when(F.col("item_id").cast("string").startswith("1"), "one").otherwise("rest")
    return probs(spark, sf_dir).groupBy(part.alias("part"), F.col("pred").alias("level")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") > F.col("y")).cast("int")), 6).alias("over"), F.round(F.avg(F.col("pred") - F.col("y")), 6).alias("bias"))


@query(f"""WITH {S.PROBS}, a AS (SELECT grp, avg(correct) FILTER (item_id % 3 = 0) AS control, avg(correct) FILTER (item_id % 3 <> 0) AS main, count(*) AS n FROM probs GROUP BY grp)
  SELECT grp, n, round(control, 6) AS control, round(main, 6) AS main, main - control > 0.03 AS above, abs(main - control) <= 0.03 AS equal FROM a""")
def control_report(spark, sf_dir):
    control = F.col("item_id") % 3 == 0
    a = probs(spark, sf_dir).groupBy("grp").agg(F.avg(F.when(control, F.col("correct"))).alias("control"), F.avg(F.when(~control, F.col("correct"))).alias("main"), F.count("*").alias("n"))
    gap = F.col("main") - F.col("control")
    return a.select("grp", "n", F.round("control", 6).alias("control"), F.round("main", 6).alias("main"), (gap > 0.03).alias("above"), (F.abs(gap) <= 0.03).alias("equal"))


_OUTSIDE = f"""{S.SCORES}, x AS (SELECT grp, item_id, y, split, round(z[5] - z[1], 9) AS s FROM scores), m AS (SELECT grp, y AS level, avg(s) AS c FROM x WHERE split = 'calibration' GROUP BY 1, 2),
  d AS (SELECT x.grp, item_id, arg_min(level, (round(abs(s - c), 9), level)) AS fitted FROM x JOIN m ON x.grp = m.grp WHERE split = 'test' GROUP BY 1, 2)"""


@query(f"""WITH {_OUTSIDE}, r AS (SELECT x.*, rank() OVER (PARTITION BY x.grp ORDER BY s) + (count(*) OVER (PARTITION BY x.grp, s) - 1) / 2::DOUBLE AS rs, rank() OVER (PARTITION BY x.grp ORDER BY y) + (count(*) OVER (PARTITION BY x.grp, y) - 1) / 2::DOUBLE AS ry FROM x WHERE split = 'test')
  SELECT r.grp, count(*) AS n, round(avg(CAST(greatest(0, least(4, floor(s + 2.5))) = y AS INT)), 6) AS raw, round(avg(CAST(fitted = y AS INT)), 6) AS fitted, round(corr(rs, ry), 6) AS srcc, avg(CAST(fitted = y AS INT)) > avg(CAST(greatest(0, least(4, floor(s + 2.5))) = y AS INT)) AS fit_helps
  FROM r JOIN d ON r.grp = d.grp AND r.item_id = d.item_id GROUP BY r.grp""")
def outside_scores(spark, sf_dir):
    """An outside system's one number per item: levels by rounding, levels by the nearest calibration mean, rank correlation."""
    x = S.scores(spark, sf_dir).select("grp", "item_id", "y", "split", F.round(F.get("z", F.lit(4)) - F.get("z", F.lit(0)), 9).alias("s"))
    per = x.filter("split = 'calibration'").groupBy("grp", "y").agg(F.avg("s").alias("c"))
    centres = per.groupBy("grp").agg(F.collect_list(F.struct("y", "c")).alias("centres"))  # a few levels a scale
    near = F.transform("centres", lambda m: F.struct(F.round(F.abs(F.col("s") - m["c"]), 9).alias("d"), m["y"].alias("y")))
    test = x.filter("split = 'test'").join(centres, "grp").select("grp", "item_id", "y", "s", F.array_min(near)["y"].alias("fitted"), F.greatest(F.lit(0), F.least(F.lit(4), F.floor(F.col("s") + 2.5))).alias("raw"))
    right = lambda c: F.avg((F.col(c) == F.col("y")).cast("int"))
    hits = test.groupBy("grp").agg(F.count("*").alias("n"), right("raw").alias("raw"), right("fitted").alias("fitted"))
    ranks = M.correlations(test, ["grp"], "s", "y").select("grp", "spearman")
    return hits.join(ranks, "grp").select("grp", "n", F.round("raw", 6).alias("raw"), F.round("fitted", 6).alias("fitted"), F.round("spearman", 6).alias("srcc"), (F.col("fitted") > F.col("raw")).alias("fit_helps"))


@query(f"WITH {S.READOUTS}, m AS (SELECT item_id, y, count(*) AS k, list_position(max(z) FILTER (method_key = 'm0'), list_max(max(z) FILTER (method_key = 'm0'))) - 1 AS p FROM readouts GROUP BY 1, 2 HAVING count(*) = 4), {S.SYSTEMS} SELECT CASE WHEN m.item_id % 2 = 0 THEN 'fit' ELSE 'test' END AS split, count(*) AS n, round(avg(CAST(p = y AS INT)), 6) AS own, round(avg(CAST(correct AS INT)), 6) AS outside FROM m JOIN systems s ON s.item_id = m.item_id AND s.system = 'a' GROUP BY 1")
def outside_alignment(spark, sf_dir):
    """Our readout and an outside system on the same items: those with all four members and an answer of the other."""
    wide = S.readouts(spark, sf_dir).groupBy("item_id", "y").agg(F.count("*").alias("k"), F.max(F.when(F.col("method_key") == "m0", F.col("z"))).alias("z")).filter("k = 4")
    other = S.systems(spark, sf_dir).filter("system = 'a'").select("item_id", "correct")
    own = (A.argmax(F.col("z")) == F.col("y")).cast("int")
    return wide.join(other, "item_id").groupBy(F.when(F.col("item_id") % 2 == 0, "fit").otherwise("test").alias("split")).agg(F.count("*").alias("n"), F.round(F.avg(own), 6).alias("own"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("outside"))


_ENCODED = """flat AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), protos AS (SELECT label AS k, i, avg(x) AS m FROM flat WHERE vec_id % 2 = 0 GROUP BY 1, 2),
  z AS (SELECT f.vec_id, f.label, p.k, round(sum(f.x * p.m) * 10.0, 9) AS z FROM flat f JOIN protos p ON f.i = p.i WHERE f.vec_id % 2 = 1 GROUP BY 1, 2, 3), e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e),
  b AS (SELECT vec_id, label, arg_max(k, (p, -k)) AS pred, sum(p * k) AS expected, max(CASE WHEN k = label THEN p END) AS py FROM p GROUP BY 1, 2)"""


@query(f"WITH {_ENCODED} SELECT count(*) AS n, round(avg(CAST(pred = label AS INT)), 6) AS accuracy, round(avg(CAST(abs(pred - label) <= 1 AS INT)), 6) AS within_one, round(avg(abs(expected - label)), 6) AS mae, round(avg(-ln(greatest(py, 1e-12))), 6) AS nll FROM b")
def feature_metrics(spark, sf_dir):
    """The usual metrics of any probability matrix, here that of a prototype classifier on embeddings."""
    rows = dual_encoder(spark, sf_dir).withColumns({"unit": F.lit(1), "label": F.col("label").cast("int")})
    b = M.bundle(rows, ["unit"], "p", "label")
    return b.select("n", *(F.round(c, 6).alias(c) for c in ("accuracy", "within_one", "mae", "nll")))


@query("SELECT p_partkey AS item_id FROM part WHERE p_size NOT IN (SELECT n_nationkey FROM nation) AND p_partkey NOT IN (SELECT s_suppkey FROM supplier) ORDER BY p_partkey LIMIT 1")
def next_unlabeled(spark, sf_dir):
    part, done = S.read(spark, sf_dir, "part"), S.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"))
    skipped = S.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("p_size"))
    return part.join(done, "p_partkey", "left_anti").join(skipped, "p_size", "left_anti").orderBy("p_partkey").select(F.col("p_partkey").alias("item_id")).limit(1)


@query("SELECT page_id, replace(url, 'https://', '') AS path, length(replace(html, '<', '')) AS n FROM pages")
def snapshot_rows(spark, sf_dir):
    """Lines of a run written as a snapshot, with their absolute root taken out, and read again."""
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    bare = F.replace("html", F.lit("<"), F.lit(""))
    lines = S.read(spark, sf_dir, "pages").select(F.concat_ws("\t", F.col("page_id").cast("string"), F.length(bare).cast("string"), "url").alias("value"))
    sinks.snapshot(lines, path, "https://")
    parts = F.split("value", "\t", 3)
    return spark.read.text(path).select(parts[0].cast("long").alias("page_id"), parts[2].alias("path"), parts[1].cast("long").alias("n"))


@query("SELECT p_partkey AS item_id FROM part WHERE p_size >= 10 AND p_retailprice >= (SELECT quantile_cont(p_retailprice, 0.3) FROM part WHERE p_size >= 10) AND p_partkey % 100 >= 20")
def source_pool(spark, sf_dir):
    """Sources large enough, no less sharp than the 30th percentile of those, and bright enough."""
    large = S.read(spark, sf_dir, "part").filter("p_size >= 10")
    least = quantiles(large, [], "p_retailprice", [0.3]).select(F.col("q")[0].alias("least"))  # one row
    return large.join(F.broadcast(least), F.col("p_retailprice") >= F.col("least")).filter("p_partkey % 100 >= 20").select(F.col("p_partkey").alias("item_id"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY text, turn)) AS canonical, md5(string_agg(text || ':' || CAST(r AS VARCHAR), chr(10) ORDER BY turn)) AS restored FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY text, turn) - 1 AS r FROM conversations) GROUP BY conv_id")
def statement_order(spark, sf_dir):
    """Statements scored in the order of their texts, whatever order they are asked in, and put back."""
    asked = S.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("text", "turn"))).alias("s"))
    scored = F.transform("s", lambda x, i: F.struct(x["turn"].alias("turn"), F.concat(x["text"], F.lit(":"), i.cast("string")).alias("z")))
    digest = lambda a: F.md5(F.array_join(a, "\n").cast("binary"))
    return asked.select("conv_id", digest(F.transform("s", lambda x: x["text"])).alias("canonical"), digest(F.transform(F.array_sort(scored), lambda x: x["z"])).alias("restored"))
