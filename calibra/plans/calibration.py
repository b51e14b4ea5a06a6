"""Prediction rows, pooled and per-suite calibration, configuration keys and the choice of a method."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.functions import text as X
from calibra.operators import calibrate as C
from calibra.operators import labelfree
from calibra.plans._register import Registry
from calibra.sources import standins as S

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
GRID = [round(-1.0 + 0.25 * i, 2) for i in range(13)]
LEVELS = ["very bad", "bad", "fair", "good", "very good"]


def _answers(spark, sf_dir) -> DataFrame:
    s = S.scores(spark, sf_dir)
    i = F.col("item_id")
    rated = s.select(F.when(F.col("grp") == "P", "human_gold").otherwise(F.col("grp")).alias("suite"), "item_id", "split", F.lit("vlm").alias("backend"), F.when(i % 2 == 0, "letter").otherwise("statement").alias("method"), F.lit("score").alias("type"), F.array(*map(F.lit, LEVELS)).alias("keys"), F.col("y").cast("string").alias("label"), F.when(i % 10 != 0, F.col("z")).alias("z"), (i % 5).cast("int").alias("picked"))
    n = S.nouls(spark, sf_dir)
    asked = n.select(F.lit("pope").alias("suite"), "item_id", "split", F.lit("vlm").alias("backend"), F.lit("pick").alias("method"), F.lit("noul").alias("type"), F.array().cast("array<string>").alias("keys"), (F.col("y") == 1).cast("string").alias("label"), F.array("z").alias("z"), F.lit(None).cast("int").alias("picked"))
    return rated.unionByName(asked)


@query(f"""WITH {S.SCORES}, {S.NOULS} SELECT CASE WHEN grp = 'P' THEN 'human_gold/score' ELSE grp END AS suite, item_id, 'score' AS type, y AS label_index, CASE WHEN item_id % 2 = 0 THEN 'letter' END AS choice_method, 5 AS n_options,
  CASE WHEN item_id % 10 = 0 THEN item_id % 5 = y ELSE list_position(z, list_max(z)) - 1 = y END AS hit FROM scores
  UNION ALL SELECT 'pope', item_id, 'noul', y, NULL, NULL, (z >= 0) = (y = 1) FROM nouls""")
def prediction_rows(spark, sf_dir):
    return C.prediction_rows(_answers(spark, sf_dir), "run").select("suite", "item_id", "type", "label_index", "choice_method", "n_options", "hit")


@query(f"WITH {S.SCORES} SELECT grp, count(*) AS n, count(*) FILTER (item_id % 10 <> 0) AS with_logits FROM scores GROUP BY grp")
def probability_rows(spark, sf_dir):
    rows = S.scores(spark, sf_dir).withColumn("z", F.when(F.col("item_id") % 10 != 0, F.col("z")))
    with_ = C.probability_rows(rows).groupBy("grp").agg(F.count("*").alias("with_logits"))
    return rows.groupBy("grp").agg(F.count("*").alias("n")).join(with_, "grp")


def _rated(spark, sf_dir) -> DataFrame:
    return S.scores(spark, sf_dir).select(F.concat(F.lit("k"), (F.expr("item_id div 2") % 2).cast("string")).alias("key"), F.col("grp").alias("suite"), F.lit("score").alias("type"), "split", "item_id", "z", F.col("y").alias("label_index"))


_TEMPS = ", ".join(f"{g}::DOUBLE" for g in GRID)
_SETS = f"""{S.SCORES}, r AS (SELECT 'k' || ((item_id // 2) % 2) AS key, grp AS suite, split, item_id, y, list_transform(z, lambda v: v - list_max(z)) AS c FROM scores),
  u AS (SELECT key, 'type' AS scope, 'score' AS name, item_id, y, c FROM r WHERE split = 'calibration' UNION ALL SELECT key, 'suite', suite, item_id, y, c FROM r WHERE split = 'calibration'),
  g AS (SELECT *, unnest([{_TEMPS}]) AS g FROM u),
  l AS (SELECT key, scope, name, g, count(*) AS n, round(avg(ln(list_sum(list_transform(c, lambda x: exp(x / exp(g))))) - c[y + 1] / exp(g)), 9) AS nll FROM g GROUP BY ALL),
  sets AS (SELECT key, scope, name, min(n) AS n, arg_min(g, (nll, g)) AS log_t FROM l GROUP BY ALL)"""


@query(f"""WITH {_SETS}, p AS (SELECT u.*, log_t, unnest(['before', 'after']) AS side FROM u JOIN sets USING (key, scope, name)),
  e AS (SELECT *, list_transform(c, lambda x: exp(x / CASE WHEN side = 'before' THEN 1 ELSE exp(log_t) END)) AS e FROM p),
  q AS (SELECT key, scope, name, side, item_id, log_t, e[y + 1] / list_sum(e) AS py, round(list_max(e) / list_sum(e), 9) AS conf, CAST(list_position(e, list_max(e)) - 1 = y AS INT) AS ok FROM e),
  o AS (SELECT *, row_number() OVER (PARTITION BY key, scope, name, side ORDER BY conf, item_id) - 1 AS i, count(*) OVER (PARTITION BY key, scope, name, side) AS m FROM q),
  b AS (SELECT *, CASE WHEN i < (m % least(15, m)) * (m // least(15, m) + 1) THEN i // (m // least(15, m) + 1) ELSE m % least(15, m) + (i - (m % least(15, m)) * (m // least(15, m) + 1)) // (m // least(15, m)) END AS bin FROM o),
  c AS (SELECT key, scope, name, side, bin, count(*) AS n, avg(conf) AS conf, avg(ok) AS ok FROM b GROUP BY ALL), x AS (SELECT key, scope, name, side, sum(n * abs(conf - ok)) / sum(n) AS ece FROM c GROUP BY ALL),
  w AS (SELECT key, scope, name, side, avg(-ln(greatest(py, 1e-12))) AS nll FROM q GROUP BY ALL)
  SELECT s.key, s.scope, s.name, s.n, round(s.log_t, 6) AS log_t, round(max(nll) FILTER (side = 'before'), 6) AS nll_before, round(max(nll) FILTER (side = 'after'), 6) AS nll_after, round(max(ece) FILTER (side = 'before'), 6) AS ece_before, round(max(ece) FILTER (side = 'after'), 6) AS ece_after
  FROM sets s JOIN w USING (key, scope, name) JOIN x USING (key, scope, name, side) GROUP BY ALL""")
def calibration_sets(spark, sf_dir):
    rows = _rated(spark, sf_dir)
    made = C.quality(rows, C.fit_sets(rows, GRID))
    return made.select("key", "scope", "name", "n", F.round(F.log("temperature"), 6).alias("log_t"), *(F.round(f"{m}_{s}", 6).alias(f"{m}_{s}") for m in ("nll", "ece") for s in ("before", "after")))


@query(f"""WITH {_SETS}, f AS (SELECT * FROM sets WHERE NOT (scope = 'suite' AND name = 'P') AND NOT (key = 'k1' AND scope = 'type')),
  a AS (SELECT r.*, CASE WHEN s.log_t IS NOT NULL THEN 'suite' WHEN t.log_t IS NOT NULL THEN 'type' END AS fit_scope, coalesce(s.log_t, t.log_t) AS g FROM r LEFT JOIN f s ON s.scope = 'suite' AND s.key = r.key AND s.name = r.suite LEFT JOIN f t ON t.scope = 'type' AND t.key = r.key WHERE split = 'test'),
  p AS (SELECT key, suite, fit_scope, list_transform(c, lambda x: exp(x / exp(g))) AS e FROM a)
  SELECT key, suite, fit_scope, count(*) AS n, round(avg(CASE WHEN fit_scope IS NOT NULL THEN list_max(e) / list_sum(e) END), 6) AS mean_top FROM p GROUP BY ALL""")
def calibrated_with_fallback(spark, sf_dir):
    rows = _rated(spark, sf_dir)
    sets = C.fit_sets(rows, GRID).filter(~((F.col("scope") == "suite") & (F.col("name") == "P")) & ~((F.col("key") == "k1") & (F.col("scope") == "type")))
    made = C.apply_sets(rows.filter("split = 'test'"), sets, prefer_suite=True)
    return made.groupBy("key", "suite", "fit_scope").agg(F.count("*").alias("n"), F.round(F.avg(F.array_max("p")), 6).alias("mean_top"))


@query()
def calibration_params(spark, sf_dir):
    """The fits of yes/no and rated suites, as a run would save them: by Newton steps and by bracketing."""
    nouls = S.nouls(spark, sf_dir).select(F.lit("k").alias("key"), F.col("grp").alias("suite"), F.lit("noul").alias("type"), "split", "item_id", F.array("z").alias("z"), F.col("y").alias("label_index"))
    rows = nouls.unionByName(_rated(spark, sf_dir).withColumn("key", F.lit("k")))
    return C.fit_sets(rows).select("scope", "name", "method", "n", *(F.round(c, 4).alias(c) for c in ("a", "b", "temperature")))


_METHODS = ("ens4d", "fast2", "digits", "jsondigits", "letters")


@query(f"""WITH f AS (SELECT c_nationkey AS k, {list(_METHODS)}[c_custkey % 5 + 1] AS m, CASE WHEN c_custkey % 3 = 0 THEN 'matrix' ELSE '{C.UNLABELED_KIND}' END AS kind FROM customer WHERE c_custkey % 11 = 0),
  p AS (SELECT k, m, CASE WHEN kind = 'matrix' THEN list_position({list(C.LABELED_ORDER)}, m) ELSE 10 + list_position({list(C.UNLABELED_ORDER)}, m) END AS p FROM f WHERE m <> 'letters'), b AS (SELECT k, arg_min(m, p) AS m FROM p GROUP BY k)
  SELECT n_name AS rubric, CASE WHEN n_nationkey % 4 > 0 THEN coalesce(m, '{C.ZERO_SHOT}') ELSE '{C.ZERO_SHOT}' END AS score_method FROM nation LEFT JOIN b ON k = n_nationkey""")
def auto_method(spark, sf_dir):
    i = F.col("c_custkey")
    fitted = S.read(spark, sf_dir, "customer").filter(i % 11 == 0).select("c_nationkey", F.get(F.array(*map(F.lit, _METHODS)), (i % 5).cast("int")).alias("score_method"), F.when(i % 3 == 0, "matrix").otherwise(C.UNLABELED_KIND).alias("kind"))
    nation = S.read(spark, sf_dir, "nation")
    named = fitted.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("rubric"), "score_method", "kind")
    rubrics = nation.select(F.col("n_name").alias("rubric"), (F.col("n_nationkey") % 4 > 0).alias("wanted"))
    return C.auto_method(rubrics, named).select("rubric", "score_method")


@query("""WITH k AS (SELECT p_partkey, '{"backend": "vlm", "choice_method": "' || CASE WHEN p_size % 2 = 0 THEN 'letter' ELSE 'independent' END || '", "image_token_budget": ' || CASE WHEN p_size % 3 = 0 THEN 'null' ELSE CAST(p_size AS VARCHAR) END || ', "model": "' || p_brand || '@\\u00e9\\ud83d\\ude00", "prompt_version": "v1"}' AS j FROM part)
  SELECT p_partkey, j AS canonical, substr(sha256(j), 1, 12) AS hash, 'cal_' || substr(sha256(j), 1, 6) AS version FROM k""")
def key_hashes(spark, sf_dir):
    size = F.col("p_size")
    fields = {"model": F.concat("p_brand", F.lit("@é😀")), "backend": F.lit("vlm"), "prompt_version": F.lit("v1"), "choice_method": F.when(size % 2 == 0, "letter").otherwise("independent"), "image_token_budget": F.when(size % 3 != 0, size)}
    rows = S.read(spark, sf_dir, "part").select("p_partkey", X.canonical_json(fields, ascii_only=True).alias("canonical"))
    return rows.select("p_partkey", "canonical", X.key_hash(F.col("canonical")).alias("hash"), X.key_version(F.col("canonical")).alias("version"))


@query("""SELECT c_custkey, '{"balance": ' || CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE CAST(c_custkey AS VARCHAR) END || ', "name": "' || c_name || ' é \\"' || c_mktsegment || '\\"", "vip": ' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS context FROM customer""")
def context_json(spark, sf_dir):
    i = F.col("c_custkey")
    fields = {"vip": i % 2 == 0, "name": F.concat("c_name", F.lit(' é "'), "c_mktsegment", F.lit('"')), "balance": F.when(i % 4 != 0, i)}
    return S.read(spark, sf_dir, "customer").select("c_custkey", X.canonical_json(fields).alias("context"))


def _b32_sql(value: str, length: int) -> str:
    return " || ".join(f"substr('{X.BASE32}', CAST((({value}) >> {5 * k}) & 31 AS INT) + 1, 1)" for k in reversed(range(length)))


@query("SELECT event_id, 'req_' || " + _b32_sql("epoch_us(ts) // 1000", 10) + " || " + " || ".join(_b32_sql(f"CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), {5 * g + 1}, 5) AS BIGINT)", 4) for g in range(4)) + " AS id FROM events")
def request_ids(spark, sf_dir):
    return S.read(spark, sf_dir, "events").select("event_id", X.request_id(F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"), F.md5(F.col("event_id").cast("string").cast("binary"))).alias("id"))


@query(f"""WITH {S.SCORES}, {S.SCORES1}, m AS (SELECT a.grp, a.item_id, a.z AS z0, b.z AS z1, count(*) OVER (PARTITION BY a.grp) AS n FROM scores a JOIN scores1 b USING (item_id)),
  f AS (SELECT grp, item_id, n, generate_subscripts(z0, 1) AS k, unnest(z0) AS v0, unnest(z1) AS v1 FROM m), s AS (SELECT grp, k, avg(v0) AS m0, stddev_pop(v0) AS s0, avg(v1) AS m1, stddev_pop(v1) AS s1 FROM f GROUP BY 1, 2)
  SELECT f.grp, f.item_id, f.k - 1 AS k, round(((v0 - m0) / (s0 + 1e-6) + (v1 - m1) / (s1 + 1e-6)) / 2, 6) AS z FROM f JOIN s ON f.grp = s.grp AND f.k = s.k WHERE n >= {C.LEAST_UNLABELED}""")
def unlabeled_readout(spark, sf_dir):
    both = S.scores(spark, sf_dir).join(S.scores(spark, sf_dir, 1).select("item_id", F.col("z").alias("z1")), "item_id").select("grp", "item_id", F.array("z", "z1").alias("members"))
    made = C.unlabeled_readout(both, ["grp"], "members").filter("z is not null")
    return made.select("grp", "item_id", F.posexplode("z").alias("k", "z")).select("grp", "item_id", F.col("k").cast("long").alias("k"), F.round("z", 6).alias("z"))


_LF_PLAN = ", ".join(f"({i}, '{a}', {d}, {'NULL' if k is None else k}, {n}, {m})" for i, (a, d, k, n, m) in enumerate(labelfree.plan(S.LEVELS)))


@query(f"""WITH {S.SCORES}, {S.SCORES1}, b AS (SELECT a.grp, a.item_id, a.y, a.split, list_concat(a.z, b.z) AS x FROM scores a JOIN scores1 b USING (item_id)),
  pl(deal, setting, draw, skew, n, rest) AS (VALUES {_LF_PLAN}),
  e AS (SELECT b.*, pl.*, coalesce(b.y = skew, true) AS own, {S.uniform_sql('item_id', 'deal')} AS key FROM b, pl WHERE split = 'calibration'),
  t AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY grp, setting, draw, own ORDER BY key, item_id) <= CASE WHEN own THEN n ELSE rest END),
  f AS (SELECT * FROM t QUALIFY count(*) OVER (PARTITION BY grp, setting, draw) = n + rest),
  al AS (SELECT grp, setting, draw, x FROM f UNION ALL SELECT grp, 'all', 0, x FROM b WHERE split = 'calibration'),
  fl AS (SELECT grp, setting, draw, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM al),
  ms AS (SELECT grp, setting, draw, i, avg(v) AS m, stddev_pop(v) + 1e-6 AS s FROM fl GROUP BY ALL),
  pm AS (SELECT grp, setting, draw, list(m ORDER BY i) AS mean, list(s ORDER BY i) AS std FROM ms GROUP BY ALL),
  z AS (SELECT b.grp, y, setting, draw, 'centred' AS variant, list_transform(list_zip(x, mean), lambda t: t[1] - t[2]) AS z FROM b JOIN pm USING (grp) WHERE split = 'test'
    UNION ALL SELECT b.grp, y, setting, draw, 'scaled', list_transform(list_zip(x, mean, std), lambda t: (t[1] - t[2]) / t[3]) FROM b JOIN pm USING (grp) WHERE split = 'test'
    UNION ALL SELECT grp, y, 'none', 0, 'raw', x FROM b WHERE split = 'test'),
  q AS (SELECT grp, y, setting, draw, variant, list_transform(list_zip(z[1:{S.LEVELS}], z[{S.LEVELS} + 1:]), lambda t: round((t[1] + t[2]) / 2, 9)) AS z FROM z),
  x AS (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM q),
  h AS (SELECT grp, variant, setting, draw, avg(CAST(list_position(e, list_max(e)) - 1 = y AS INT)) AS hit, avg(abs(list_sum(list_transform(list_zip(e, [0, 1, 2, 3, 4]), lambda t: t[1] * t[2])) / list_sum(e) - y)) AS off,
    avg(CAST(abs(list_position(e, list_max(e)) - 1 - y) <= 1 AS INT)) AS near FROM x GROUP BY ALL),
  g AS (SELECT grp, variant, setting, count(*) AS draws, avg(hit) AS accuracy, avg(off) AS mae, avg(near) AS within_one FROM h GROUP BY ALL)
  SELECT grp, variant, setting, draws, round(accuracy, 6) AS accuracy, round(mae, 6) AS mae, round(within_one, 6) AS within_one, round(accuracy - max(CASE WHEN variant = 'raw' THEN accuracy END) OVER (PARTITION BY grp), 6) AS gain FROM g""")
def label_free_tables(spark, sf_dir):
    """Accuracy, MAE and within-one of two members' mean readout after correction by pools of each kind, against raw."""
    both = S.scores(spark, sf_dir).join(S.scores(spark, sf_dir, 1).select("item_id", F.col("z").alias("z1")), "item_id")
    rows = both.select("grp", "item_id", "split", F.col("y").alias("level"), F.concat("z", "z1").alias("x"))
    made = labelfree.tables(rows.filter("split = 'calibration'"), rows.filter("split = 'test'"), "grp", "item_id", S.LEVELS, 2, lambda deal, tie: S.uniform(tie, deal))
    return made.select("grp", "variant", "setting", "draws", *(F.round(c, 6).alias(c) for c in ("accuracy", "mae", "within_one", "gain")))
