"""Joins, splits, sets and lookups."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from calibra.functions import arrays as A
from calibra.operators import assign
from calibra.operators.quantiles import quantiles
from calibra.operators.ranks import running
from calibra.plans._register import Registry
from calibra.plans.scoring import probs
from calibra.sources import standins as S

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _leading(c: str):
    """The first 52 bits of a text's MD5 as a number, which rises as the MD5 does."""
    return F.conv(F.substring(F.md5(F.col(c).cast("binary")), 1, 13), 16, 10).cast("long")


@query(f"WITH {S.SCORES} SELECT item_id, grp FROM scores s WHERE NOT EXISTS (SELECT 1 FROM scores d WHERE d.item_id = s.item_id AND d.grp = s.grp AND d.item_id % 7 < 3)")
def resume_anti_join(spark, sf_dir):
    todo = S.scores(spark, sf_dir).select("item_id", "grp")
    return todo.join(todo.filter("item_id % 7 < 3"), ["item_id", "grp"], "left_anti")


@query(f"WITH {S.PROBS}, {S.SYSTEMS} SELECT grp, count(*) AS n, round(avg(correct), 6) AS accuracy FROM probs p WHERE EXISTS (SELECT 1 FROM systems s WHERE s.item_id = p.item_id AND s.system = 'a') GROUP BY grp")
def same_items_semi(spark, sf_dir):
    hosted = S.systems(spark, sf_dir).filter("system = 'a'").select("item_id")
    return probs(spark, sf_dir).join(hosted, "item_id", "left_semi").groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("correct"), 6).alias("accuracy"))


@query(f"""WITH {S.PROBS}, {S.SYSTEMS} SELECT grp, item_id FROM probs p WHERE split = 'test' AND EXISTS (SELECT 1 FROM systems s WHERE s.item_id = p.item_id AND s.system = 'a')
  AND NOT EXISTS (SELECT 1 FROM systems s WHERE s.item_id = p.item_id AND s.system = 'b') QUALIFY row_number() OVER (PARTITION BY grp ORDER BY item_id) <= 300""")
def baseline_worklist(spark, sf_dir):
    s = S.systems(spark, sf_dir)
    asked = lambda k: s.filter(F.col("system") == k).select("item_id")
    todo = S.scores(spark, sf_dir).filter("split = 'test'").join(asked("a"), "item_id", "left_semi").join(asked("b"), "item_id", "left_anti")
    return todo.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("item_id"))).filter("r <= 300").select("grp", "item_id")


_PARAMS = "params AS (SELECT * FROM (VALUES ('F', 'letter', 2.0::DOUBLE, 0), ('F', 'independent', 1.5::DOUBLE, 1), ('O', 'independent', 1.2::DOUBLE, 2), ('P', 'letter', 3.0::DOUBLE, 3)) AS t(grp, method, temperature, ord))"


@query(f"""WITH {S.SCORES}, {_PARAMS}, q AS (SELECT item_id, grp, CASE WHEN item_id % 2 = 0 THEN 'letter' END AS method FROM scores), f AS (SELECT grp, arg_min(temperature, ord) AS t FROM params GROUP BY grp)
  SELECT q.item_id, coalesce(p.temperature, f.t) AS temperature FROM q LEFT JOIN params p ON p.grp = q.grp AND p.method = coalesce(q.method, 'independent') LEFT JOIN f ON f.grp = q.grp""")
def calibration_lookup_fallback(spark, sf_dir):
    params = spark.createDataFrame([("F", "letter", 2.0, 0), ("F", "independent", 1.5, 1), ("O", "independent", 1.2, 2), ("P", "letter", 3.0, 3)], "grp string, method string, temperature double, ord int")
    q = S.scores(spark, sf_dir).select("item_id", "grp", F.coalesce(F.when(F.col("item_id") % 2 == 0, "letter"), F.lit("independent")).alias("method"))
    first = params.groupBy("grp").agg(F.min_by("temperature", "ord").alias("fallback"))
    return q.join(F.broadcast(params.drop("ord")), ["grp", "method"], "left").join(F.broadcast(first), "grp", "left").select("item_id", F.coalesce("temperature", "fallback").alias("temperature"))


@query(f"""WITH {S.SCORES}, {S.SCORES1}, j AS (SELECT a.item_id, [b.z[4], b.z[1], b.z[3]] AS z, a.z[4] AS l0 FROM scores a JOIN scores1 b USING (item_id))
  SELECT item_id, round(exp(z[1] - list_max(z)) / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 6) AS p0, round(l0, 6) AS letter0 FROM j""")
def letter_vs_independent_gather(spark, sf_dir):
    keys = F.array(*map(F.lit, ("d", "a", "c")))
    all_keys = F.array(*map(F.lit, "abcde"))
    letter, independent = S.scores(spark, sf_dir).select("item_id", "z"), S.scores(spark, sf_dir, 1).select("item_id", F.col("z").alias("iz"))
    gathered = F.transform(keys, lambda k: F.get(F.col("iz"), F.array_position(all_keys, k).cast("int") - 1))
    return letter.join(independent, "item_id").select("item_id", F.round(F.get(A.softmax(gathered), F.lit(0)), 6).alias("p0"), F.round(F.get("z", F.lit(3)), 6).alias("letter0"))


@query(f"""WITH {S.READOUTS}, g AS (SELECT ladder, item_id, generate_subscripts(z, 1) AS k, unnest(z) AS v, latency_ms FROM readouts WHERE method_key IN ('m0', 'm1', 'm2')),
  h AS (SELECT ladder, item_id FROM readouts WHERE method_key IN ('m0', 'm1', 'm2') GROUP BY 1, 2 HAVING count(*) = 3)
  SELECT ladder, item_id, round(max(m), 6) AS top, round(max(l), 6) AS latency FROM (SELECT ladder, item_id, k, avg(v) AS m, sum(latency_ms) AS l FROM g JOIN h USING (ladder, item_id) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def combine_readouts(spark, sf_dir):
    keys = ["m0", "m1", "m2"]
    wide = S.readouts(spark, sf_dir).groupBy("ladder", "item_id").pivot("method_key", keys).agg(F.first("z").alias("z"), F.first("latency_ms").alias("ms"))
    whole = wide.dropna(subset=[f"{k}_z" for k in keys])
    return whole.select("ladder", "item_id", F.round(F.array_max(A.mean_of(F.array(*(f"{k}_z" for k in keys)))), 6).alias("top"), F.round(sum((F.col(f"{k}_ms") for k in keys), F.lit(0.0)), 6).alias("latency"))


@query(f"""WITH {S.READOUTS}, p AS (SELECT a.ladder, a.item_id, list_max(list_transform(list_zip(a.z, b.z), lambda t: abs(t[1] - t[2]))) AS d, list_position(a.z, list_max(a.z)) = list_position(b.z, list_max(b.z)) AS same
  FROM readouts a JOIN readouts b ON a.item_id = b.item_id AND a.ladder = b.ladder AND a.method_key = 'm0' AND b.method_key = 'm1')
  SELECT ladder, count(*) AS n, round(max(d), 6) AS max_dz, round(quantile_cont(d, 0.5), 6) AS median_dz, round(avg(CAST(same AS INT)), 6) AS same FROM p GROUP BY ladder""")
def cached_vs_reference(spark, sf_dir):
    r = S.readouts(spark, sf_dir)
    side = lambda k: r.filter(F.col("method_key") == k).select("ladder", "item_id", F.col("z").alias(k))
    p = side("m0").join(side("m1"), ["ladder", "item_id"]).withColumn("d", F.array_max(F.zip_with("m0", "m1", lambda a, b: F.abs(a - b)))).withColumn("same", A.argmax(F.col("m0")) == A.argmax(F.col("m1")))
    same = p.groupBy("ladder").agg(F.round(F.avg(F.col("same").cast("int")), 6).alias("same"))
    return quantiles(p, ["ladder"], "d", [0.5]).join(same, "ladder").select("ladder", "n", F.round("hi", 6).alias("max_dz"), F.round(F.col("q")[0], 6).alias("median_dz"), "same")


@query(f"""WITH {S.READOUTS}, e AS (SELECT ladder, item_id, method_key, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM readouts), p AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e),
  j AS (SELECT s.method_key, list_max(list_transform(list_zip(b.p, s.p), lambda t: abs(t[1] - t[2]))) AS d, list_position(b.p, list_max(b.p)) <> list_position(s.p, list_max(s.p)) AS flip FROM p b JOIN p s USING (ladder, item_id) WHERE b.method_key = 'm0' AND s.method_key <> 'm0')
  SELECT method_key, round(max(d), 6) AS max_dp, count(*) FILTER (flip) AS flips FROM j GROUP BY method_key""")
def permutation_flips(spark, sf_dir):
    p = S.readouts(spark, sf_dir).withColumn("p", A.softmax(F.col("z")))
    base = p.filter("method_key = 'm0'").select("ladder", "item_id", F.col("p").alias("b"))
    j = p.filter("method_key <> 'm0'").join(base, ["ladder", "item_id"])
    d = F.array_max(F.zip_with("p", "b", lambda a, b: F.abs(a - b)))
    return j.groupBy("method_key").agg(F.round(F.max(d), 6).alias("max_dp"), F.count_if(A.argmax(F.col("p")) != A.argmax(F.col("b"))).alias("flips"))


@query(f"""WITH {S.SYSTEMS}, asked AS (SELECT DISTINCT item_id FROM systems WHERE system IN ('a', 'b')), g AS (SELECT item_id, unnest(['a', 'b', 'c']) AS system FROM asked)
  SELECT g.system, count(*) AS n, round(avg(CAST(coalesce(s.correct, false) AS INT)), 6) AS accuracy FROM g LEFT JOIN systems s ON s.item_id = g.item_id AND s.system = g.system GROUP BY g.system""")
def union_missing_wrong(spark, sf_dir):
    s = S.systems(spark, sf_dir)
    wide = s.groupBy("item_id").pivot("system", ["a", "b", "c"]).agg(F.first("correct")).filter("a is not null or b is not null")
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("system"), F.coalesce(k, F.lit(False)).alias("correct")) for k in "abc"))).alias("s")).select("s.*")
    return long.groupBy("system").agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


@query(f"WITH {S.SYSTEMS}, w AS (SELECT item_id FROM systems GROUP BY item_id HAVING count(DISTINCT system) = 3) SELECT system, count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS accuracy FROM systems JOIN w USING (item_id) GROUP BY system")
def all_systems_intersection(spark, sf_dir):
    wide = S.systems(spark, sf_dir).groupBy("item_id").agg(F.collect_list(F.struct("system", "correct")).alias("s"), F.count_distinct("system").alias("k")).filter("k = 3")
    return wide.select(F.inline("s")).groupBy("system").agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


@query(f"WITH {S.PROBS}, g AS (SELECT grp, sum(correct) AS s, count(*) AS n FROM probs GROUP BY grp) SELECT a.grp AS target, round(sum(b.s) / sum(b.n), 6) AS others FROM g a JOIN g b ON a.grp <> b.grp GROUP BY a.grp")
def loro_pairs(spark, sf_dir):
    g = probs(spark, sf_dir).groupBy("grp").agg(F.sum("correct").alias("s"), F.count("*").alias("n"))  # a row for each rubric
    a = g.select(F.col("grp").alias("target"))
    return a.join(F.broadcast(g), F.col("target") != F.col("grp")).groupBy("target").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("others"))


@query(f"WITH {S.SCORES}, o AS (SELECT grp, item_id, row_number() OVER (PARTITION BY grp ORDER BY item_id) AS pos FROM scores) SELECT grp, count(*) AS n, count(*) FILTER (pos <= 100) AS verified, count(*) FILTER (pos > 100) AS appended, 0::BIGINT AS mismatches FROM o GROUP BY grp")
def manifest_verify(spark, sf_dir):
    new = running(S.scores(spark, sf_dir).select("grp", "item_id"), ["grp"], "item_id", "item_id").select("grp", "item_id", F.col("_rank").alias("pos"))
    committed = new.filter("pos <= 100").select("grp", "pos", F.col("item_id").alias("was"))
    return new.join(committed, ["grp", "pos"], "left").groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("was") == F.col("item_id")).alias("verified"), F.count_if(F.col("was").isNull()).alias("appended"), F.count_if(F.col("was") != F.col("item_id")).alias("mismatches"))


@query("""WITH k AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'part:' || item_id WHEN 1 THEN 'a/' || item_id ELSE CAST(item_id AS VARCHAR) END AS id FROM (SELECT l_orderkey AS o, l_linenumber, l_partkey AS item_id FROM lineitem)),
  p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand FROM part) SELECT coalesce(p.p_brand, 'unknown') AS brand, count(*) AS n FROM k LEFT JOIN p ON p.id = split_part(split_part(k.id, '/', -1), ':', -1) GROUP BY 1""")
def params_lookup_coalesce(spark, sf_dir):
    i = F.col("l_partkey")
    text = i.cast("string")
    ids = S.read(spark, sf_dir, "lineitem").select(F.when(i % 3 == 0, F.concat(F.lit("part:"), text)).when(i % 3 == 1, F.concat(F.lit("a/"), text)).otherwise(text).alias("id"))
    params = S.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), "p_brand")
    counted = ids.groupBy("id").count()  # one row for each id before the lookups
    by = lambda name, c: params.select(F.col("k").alias(f"{name}_k"), F.col("p_brand").alias(name))
    j = counted
    for name, c in (("b1", F.col("id")), ("b2", F.element_at(F.split("id", "/"), -1)), ("b3", F.element_at(F.split("id", ":"), -1))):
        j = j.join(by(name, c), c == F.col(f"{name}_k"), "left")
    return j.groupBy(F.coalesce("b1", "b2", "b3", F.lit("unknown")).alias("brand")).agg(F.sum("count").alias("n"))


@query(f"""WITH {S.READOUTS}, m AS (SELECT ladder, method_key, quantile_cont(latency_ms, 0.5) AS p50 FROM readouts GROUP BY 1, 2)
  SELECT ladder, round(CASE WHEN count(p50) = 4 THEN sum(p50) ELSE 999 END, 6) AS latency FROM m GROUP BY ladder""")
def latency_override(spark, sf_dir):
    m = quantiles(S.readouts(spark, sf_dir), ["ladder", "method_key"], "latency_ms", [0.5]).select("ladder", F.col("q")[0].alias("p50"))
    return m.groupBy("ladder").agg(F.round(F.when(F.count("p50") == 4, F.sum("p50")).otherwise(F.lit(999.0)), 6).alias("latency"))


@query("SELECT o_custkey AS view, substr(o_orderpriority, 1, 1) AS prefix, count(*) AS statements, min(o_orderkey) AS first_id FROM orders GROUP BY 1, 2")
def call_packing(spark, sf_dir):
    o = S.read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("view"), F.substring("o_orderpriority", 1, 1).alias("prefix")).agg(F.count("*").alias("statements"), F.min("o_orderkey").alias("first_id"))


@query("SELECT o_orderstatus AS grp, o_orderkey AS item_id, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 2 AS half, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 4) % 2 AS by_four FROM orders")
def split_alternate(spark, sf_dir):
    r = F.col("_rank") - 1
    return running(S.read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], "o_orderkey", "o_orderkey").select(F.col("o_orderstatus").alias("grp"), F.col("o_orderkey").alias("item_id"), F.pmod(r, F.lit(2)).alias("half"), F.pmod(F.floor(r / 4), F.lit(2)).cast("long").alias("by_four"))


@query("WITH r AS (SELECT source, rank() OVER (ORDER BY md5(source)) AS r FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, CASE WHEN r % 2 = 1 THEN 'calibration' ELSE 'test' END AS split FROM documents JOIN r USING (source)")
def split_by_source(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents").select("doc_id", "source")
    refs = d.select("source").distinct().withColumns({"m": F.md5(F.col("source").cast("binary")), "h": _leading("source"), "_one": F.lit(1)})
    refs = running(refs, ["_one"], "h", "source", order=[F.col("m")]).select("source", F.col("_rank").alias("r"))
    return d.join(refs, "source").select("doc_id", F.when(F.col("r") % 2 == 1, "calibration").otherwise("test").alias("split"))


@query("SELECT grp, item_id FROM (SELECT o_orderstatus AS grp, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders) WHERE r <= 50")
def first_n(spark, sf_dir):
    w = Window.partitionBy("o_orderstatus").orderBy(F.md5(F.col("o_orderkey").cast("string").cast("binary")), "o_orderkey")
    return S.read(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 50").select(F.col("o_orderstatus").alias("grp"), F.col("o_orderkey").alias("item_id"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS fold FROM labels")
def kfold(spark, sf_dir):
    rows = S.read(spark, sf_dir, "labels").select("doc_id", "quality", F.col("doc_id").cast("string").alias("id")).withColumn("h", _leading("id"))
    ranked = running(rows, ["quality"], "h", "doc_id", order=[F.md5(F.col("id").cast("binary"))])
    return ranked.select("doc_id", F.pmod(F.col("_rank") - 1, F.lit(5)).alias("fold"))


@query(f"WITH {S.SCORES}, c AS (SELECT grp, item_id, row_number() OVER (PARTITION BY grp ORDER BY item_id) AS r, count(*) OVER (PARTITION BY grp) AS n FROM scores WHERE split = 'calibration') SELECT grp, count(*) FILTER (r <= n // 2) AS fit, count(*) FILTER (r > n // 2) AS dev, min(item_id) FILTER (r > n // 2) AS first_dev FROM c GROUP BY grp")
def dev_halves(spark, sf_dir):
    c = S.scores(spark, sf_dir).filter("split = 'calibration'")
    r = running(c.select("grp", "item_id"), ["grp"], "item_id", "item_id").withColumn("early", F.col("_rank") <= F.expr("_n div 2"))
    return r.groupBy("grp").agg(F.count_if("early").alias("fit"), F.count_if(~F.col("early")).alias("dev"), F.min(F.when(~F.col("early"), F.col("item_id"))).alias("first_dev"))


@query(f"WITH {S.SCORES}, d AS (SELECT grp, y, item_id, unnest([0, 1, 2]) AS draw FROM scores) SELECT grp, draw, y, item_id FROM d QUALIFY row_number() OVER (PARTITION BY grp, draw, y ORDER BY md5(CAST(item_id * 31 + draw AS VARCHAR)), item_id) <= 4")
def balanced_draw(spark, sf_dir):
    d = S.scores(spark, sf_dir).select("grp", "y", "item_id", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("draw"))
    w = Window.partitionBy("grp", "draw", "y").orderBy(F.md5((F.col("item_id") * 31 + F.col("draw")).cast("string").cast("binary")), "item_id")
    return d.withColumn("r", F.row_number().over(w)).filter("r <= 4").drop("r").select("grp", "draw", "y", "item_id")


@query(f"WITH {S.SCORES}, u AS (SELECT item_id, grp, 'one' AS run FROM scores WHERE item_id % 2 = 0 UNION ALL BY NAME SELECT item_id, 'two' AS run FROM scores WHERE item_id % 3 = 0) SELECT run, count(*) AS n, count(grp) AS with_grp FROM u GROUP BY run")
def union_of_runs(spark, sf_dir):
    s = S.scores(spark, sf_dir)
    one = s.filter("item_id % 2 = 0").select("item_id", "grp", F.lit("one").alias("run"))
    two = s.filter("item_id % 3 = 0").select("item_id", F.lit("two").alias("run"))
    return one.unionByName(two, allowMissingColumns=True).groupBy("run").agg(F.count("*").alias("n"), F.count("grp").alias("with_grp"))


@query("SELECT source, arg_min(lang, doc_id) AS first_lang, arg_max(lang, doc_id) AS last_lang FROM documents GROUP BY source")
def first_last_wins(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("lang", "doc_id").alias("first_lang"), F.max_by("lang", "doc_id").alias("last_lang"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0")
def set_difference(spark, sf_dir):
    used = S.read(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("id"))
    return S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).distinct().join(used, "id", "left_anti")


@query("SELECT lang, count(DISTINCT source) AS feasible, CAST(row_number() OVER (ORDER BY count(DISTINCT source), lang) AS INT) AS place FROM documents WHERE n_chars > 300 GROUP BY lang")
def level_scarcity(spark, sf_dir):
    g = S.read(spark, sf_dir, "documents").filter("n_chars > 300").groupBy("lang").agg(F.count_distinct("source").alias("feasible"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("feasible", "lang")))  # a row for each level


_LEVELS, _WANTED = 5, 6
#: A document can have level k if its number of characters is divisible by k + 2; the higher the level, the fewer can.
_ABLE = "SELECT coalesce(lang, '') AS lang, doc_id, md5(doc_id || ':source') AS h, unnest([0, 1, 2, 3, 4]) AS level, n_chars FROM documents"


def _able(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("")).alias("lang"), "doc_id", "n_chars", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":source")).cast("binary")).alias("h"))
    return d.select("*", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS - 1))).alias("level")).filter("n_chars % ((level + 2) * (level + 2)) = 0")


def _assign_sql(select: str) -> str:
    """The assignment as a chain of picks, a turn each."""
    ctes = [f"a AS (SELECT lang, doc_id, h, level FROM ({_ABLE}) WHERE n_chars % ((level + 2) * (level + 2)) = 0)", f"u AS (SELECT DISTINCT lang, unnest(range({_LEVELS})) AS level FROM a)",
        "t AS (SELECT u.lang, u.level, row_number() OVER (PARTITION BY u.lang ORDER BY count(a.doc_id), u.level) - 1 AS turn FROM u LEFT JOIN a ON a.lang = u.lang AND a.level = u.level GROUP BY u.lang, u.level)"]
    for i in range(_LEVELS):
        used = " UNION ALL ".join(f"SELECT lang, doc_id FROM p{j}" for j in range(i)) or "SELECT lang, doc_id FROM a WHERE false"
        ctes.append(f"p{i} AS (SELECT a.lang, a.level, a.doc_id, row_number() OVER (PARTITION BY a.lang ORDER BY h, a.doc_id) - 1 AS place FROM a JOIN t ON t.lang = a.lang AND t.level = a.level AND t.turn = {i} WHERE NOT EXISTS (SELECT 1 FROM ({used}) x WHERE x.lang = a.lang AND x.doc_id = a.doc_id) QUALIFY place < {_WANTED})")
    ctes.append("p AS (" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(_LEVELS)) + ")")
    return "WITH " + ", ".join(ctes) + " " + select


@query(_assign_sql("SELECT lang, CAST(level AS INT) AS level, doc_id, CAST(place AS INT) AS place, CASE WHEN place % 2 = 0 THEN 'calibration' ELSE 'test' END AS split FROM p"))
def consume_once(spark, sf_dir):
    """Sources dealt to the levels of each scale, each once, the scarcest level first."""
    taken, _ = assign.assign(_able(spark, sf_dir), "lang", "doc_id", F.col("h"), _LEVELS, _WANTED)
    return taken.withColumn("split", F.when(F.col("place") % 2 == 0, "calibration").otherwise("test"))


@query(_assign_sql(f"SELECT t.lang, CAST(t.level AS INT) AS level, {_WANTED} AS needed, count(p.doc_id) AS got FROM t LEFT JOIN p ON p.lang = t.lang AND p.level = t.level GROUP BY t.lang, t.level HAVING count(p.doc_id) < {_WANTED}"))
def consume_once_shortfalls(spark, sf_dir):
    """The levels that the sources cannot fill, all of them."""
    return assign.assign(_able(spark, sf_dir), "lang", "doc_id", F.col("h"), _LEVELS, _WANTED)[1]
