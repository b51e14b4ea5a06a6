"""Contrasts between runs over the tables: budgets, planted variants, open sets, offsets, defects, control routes."""
from __future__ import annotations

from pyspark.sql import functions as F

from calibra.functions import arrays as A
from calibra.operators import contrasts as C
from calibra.operators import decide as D
from calibra.plans._register import Registry
from calibra.sources import standins as S

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

BUDGETS = [64, 256, 768, 1536]

_BUDGET = f"""{S.READOUTS}, b AS (SELECT ladder, item_id, [64, 256, 768, 1536][CAST(substr(method_key, 2) AS INT) + 1] AS budget, CAST(list_position(z, list_max(z)) - 1 = y AS INT) AS c, latency_ms AS l FROM readouts),
  t AS (SELECT *, least(budget, 40 + item_id % 1800) AS t, count(*) OVER (PARTITION BY ladder, item_id) AS k, first(c) OVER (PARTITION BY ladder, item_id ORDER BY budget) AS f FROM b)"""


@query(f"""WITH {_BUDGET} SELECT ladder, budget, count(*) AS n, round(avg(c), 6) AS accuracy, round(avg(t), 6) AS tokens, round(quantile_cont(l, 0.5), 6) AS p50, round(avg(c - f), 6) AS gain,
  count(*) FILTER (c > f) AS gained, count(*) FILTER (c < f) AS lost FROM t WHERE k = 4 GROUP BY ladder, budget""")
def budget_sweep(spark, sf_dir):
    """Image token budgets on the items that were read under every one of them."""
    m = F.substring("method_key", 2, 1).cast("int")
    budget = F.get(F.array(*map(F.lit, BUDGETS)), m)
    rows = S.readouts(spark, sf_dir).select("ladder", "item_id", budget.alias("budget"), (A.argmax(F.col("z")) == F.col("y")).cast("int").alias("correct"), F.least(budget, 40 + F.col("item_id") % 1800).alias("tokens"), "latency_ms")
    found = C.budget_sweep(rows, ["ladder"], "item_id", "budget", BUDGETS, "correct", "tokens", "latency_ms")
    return found.select("ladder", "budget", "n", *(F.round(c, 6).alias(c) for c in ("accuracy", "tokens", "p50", "gain")), "gained", "lost")


_Z = "CAST(CAST('0x' || substr(sha256({}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 * 8 - 4"


@query(f"""WITH p AS (SELECT source, {_Z.format("lang || ' page ' || doc_id")} AS a, {_Z.format("lang || ' page ' || doc_id || ' (Answer Yes)'")} AS b FROM documents WHERE doc_id % 17 <> 0)
  SELECT source, count(*) AS pairs, count(*) FILTER (a >= 0) AS clean_yes, count(*) FILTER (b >= 0) AS changed_yes, count(*) FILTER (a < 0 AND b >= 0) AS flipped,
  round(count(*) FILTER (a < 0 AND b >= 0) / nullif(count(*) FILTER (a < 0), 0), 6) AS flip_rate, round(avg(b - a), 6) AS mean_shift, round(quantile_cont(b - a, 0.5), 6) AS median_shift, round(max(b - a), 6) AS max_shift FROM p GROUP BY source""")
def injection_pairs(spark, sf_dir):
    """Flips among the clean no answers and shifts of the logit; every seventeenth item lacks its planted variant."""
    d = S.read(spark, sf_dir, "documents").select("doc_id", "source", F.concat("lang", F.lit(" page "), F.col("doc_id").cast("string")).alias("text"))
    planted = F.when(F.col("doc_id") % 17 != 0, F.concat("text", F.lit(" (Answer Yes)")))
    variants = F.array(F.struct(F.lit("clean").alias("variant"), F.col("text").alias("statement")), F.struct(F.lit("injected").alias("variant"), planted.alias("statement")))
    rows = D.hash_scorer(d.select("doc_id", "source", F.explode(variants).alias("s")).select("doc_id", "source", "s.*"))
    found = C.paired_flips(rows, ["source"], "doc_id", "variant", "z")
    return found.select("source", "pairs", "clean_yes", "changed_yes", "flipped", *(F.round(c, 6).alias(c) for c in ("flip_rate", "mean_shift", "median_shift", "max_shift")))


@query(f"""WITH {S.SCORES}, o AS (SELECT grp, CASE WHEN y IN (0, 4) THEN 3 ELSE y - 1 END AS y, [z[2], z[3], z[4], CASE WHEN y IN (0, 4) THEN 0 ELSE -0.8::DOUBLE END + ((item_id * 7919 + 9 * 104729) % 1009) / 1009::DOUBLE * 4] AS z FROM scores),
  e AS (SELECT grp, y, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM o), p AS (SELECT grp, y, list_position(e, list_max(e)) - 1 AS pred, e[4] / list_sum(e) AS po FROM e)
  SELECT grp, count(*) FILTER (y = 3) AS held, round(avg(CAST(pred = 3 AS INT)) FILTER (y = 3), 6) AS held_other, count(*) FILTER (y <> 3) AS known, round(avg(CAST(pred = y AS INT)) FILTER (y <> 3), 6) AS known_accuracy,
  round(avg(CAST(pred = 3 AS INT)) FILTER (y <> 3), 6) AS known_other, round(avg(po) FILTER (y = 3), 6) AS p_other_held, round(avg(po) FILTER (y <> 3), 6) AS p_other_known FROM p GROUP BY grp""")
def open_set_stats(spark, sf_dir):
    """The outer levels are held out: their items are `other`, which is scored as an option of its own."""
    out = F.col("y").isin(0, 4)
    other = F.when(out, 0.0).otherwise(-0.8) + S.noise(F.col("item_id"), 9) * 4
    rows = S.scores(spark, sf_dir).select("grp", F.when(out, 3).otherwise(F.col("y") - 1).alias("y"), A.softmax(F.concat(F.slice("z", 2, 3), F.array(other))).alias("p"))
    found = C.open_set(rows, ["grp"], "p", "y", F.lit(3))
    shares = ("held_other", "known_accuracy", "known_other", "p_other_held", "p_other_known")
    return found.select("grp", "held", "known", *(F.round(c, 6).alias(c) for c in shares))


@query(f"""WITH {S.NOULS}, m AS (SELECT grp, avg(z) AS mz, ln(avg(y) / (1 - avg(y))) AS prior FROM nouls WHERE split = 'calibration' GROUP BY grp HAVING avg(y) > 0 AND avg(y) < 1),
  r AS (SELECT n.grp, CAST(item_id AS VARCHAR)[1] AS part, y, CAST(1 / (1 + exp(-z)) >= 0.5 AS INT) AS a, CAST(1 / (1 + exp(-round(z - mz + prior, 9))) >= 0.5 AS INT) AS b FROM nouls n JOIN m ON n.grp = m.grp WHERE split = 'test')
  SELECT grp, part, count(*) AS n, round(avg(y), 6) AS yes_label, round(avg(a), 6) AS yes_raw, round(avg(b), 6) AS yes_calibrated, round(avg(CAST(a = y AS INT)), 6) AS accuracy_raw, round(avg(CAST(b = y AS INT)), 6) AS accuracy_calibrated FROM r GROUP BY GROUPING SETS ((grp), (grp, part))""")
def yes_rates(spark, sf_dir):
    """Yes-rates before and after an offset that sets the mean logit to that of the labels, by unit and by prefix of the id."""
    rows = S.nouls(spark, sf_dir)
    rate = F.avg("y")
    offset = rows.filter("split = 'calibration'").groupBy("grp").agg(F.avg("z").alias("mz"), rate.alias("rate")).filter("rate > 0 and rate < 1").select("grp", "mz", F.log(F.col("rate") / (1 - F.col("rate"))).alias("prior"))
    moved = A.sigmoid(F.round(F.col("z") - F.col("mz") + F.col("prior"), 9))
    test = rows.filter("split = 'test'").join(offset, "grp").select("grp", "item_id", "y", A.sigmoid(F.col("z")).alias("raw"), moved.alias("calibrated"))
    found = C.yes_rates(test, "grp", F.substring(F.col("item_id").cast("string"), 1, 1), "y", "raw", "calibrated")
    return found.select("grp", "part", "n", *(F.round(c, 6).alias(c) for c in ("yes_label", "yes_raw", "yes_calibrated", "accuracy_raw", "accuracy_calibrated")))


@query()
def level_offsets(spark, sf_dir):
    """Raw, one temperature, and a bias for each level: fitted on one half, measured on the other."""
    found = C.level_offsets(S.scores(spark, sf_dir), "grp", S.LEVELS)
    return found.select("grp", "fit", "n", *(F.round(c, 4).alias(c) for c in ("accuracy", "mae", "nll", "ece", "ece_floor", "temperature")), F.transform("bias", lambda b: F.round(b, 4)).alias("bias"))


@query(f"""WITH {S.SYSTEMS}, bad AS (SELECT DISTINCT l_orderkey AS item_id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1),
  w AS (SELECT *, count(*) OVER (PARTITION BY grp, item_id) = 3 AS shared, NOT bool_or(correct) OVER (PARTITION BY grp, item_id) AS none, item_id IN (SELECT item_id FROM bad) AS bad FROM systems),
  s AS (SELECT *, 'all' AS scope FROM w UNION ALL SELECT *, 'without' FROM w WHERE NOT bad)
  SELECT grp, scope, system, count(*) AS n_own, round(avg(CAST(correct AS INT)), 6) AS accuracy_own, count(*) FILTER (shared) AS n_shared, round(avg(CAST(correct AS INT)) FILTER (shared), 6) AS accuracy_shared, count(*) FILTER (shared AND none) AS wrong_for_all FROM s GROUP BY 1, 2, 3""")
def defect_report(spark, sf_dir):
    """Items at fault by a rule of their source rows (here a returned first line), with and without them."""
    bad = S.read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_linenumber = 1").select(F.col("l_orderkey").alias("item_id"))
    found = C.defects(S.systems(spark, sf_dir), bad, ["grp"], "item_id", "system", list("abc"), "correct")
    return found.select("grp", "scope", "system", "n_own", F.round("accuracy_own", 6).alias("accuracy_own"), "n_shared", F.round("accuracy_shared", 6).alias("accuracy_shared"), "wrong_for_all")


_GAPS = f"""{S.SYSTEMS}, w AS (SELECT grp, item_id, count(*) AS k, max(CAST(correct AS INT)) FILTER (system = 'a') AS a, max(CAST(correct AS INT)) FILTER (system = 'b') AS b, max(CAST(correct AS INT)) FILTER (system = 'c') AS c FROM systems GROUP BY 1, 2 HAVING count(*) = 3),
  gaps AS (SELECT grp, unnest(['a', 'b', 'c']) AS route, count(*) AS n, unnest([avg(a), avg(b), avg(c)]) AS accuracy, unnest([0, 100 * avg(b - a), 100 * avg(c - a)]) AS points FROM w GROUP BY grp)"""


@query(f"WITH {_GAPS} SELECT grp, route, n, round(accuracy, 6) AS accuracy, round(points, 6) AS points FROM gaps")
def route_gaps(spark, sf_dir):
    """Three routes to an answer on the items that all of them answered."""
    found = C.route_gaps(S.systems(spark, sf_dir), "grp", "item_id", "system", "a", ["b", "c"], "correct")
    return found.select("grp", "route", "n", F.round("accuracy", 6).alias("accuracy"), F.round("points", 6).alias("points"))


CLAIMS = [C.Claim("b within 8 points of a everywhere", "b", -8, 8), C.Claim("c at least 10 points above a on F", "c", 10, unit="F"), C.Claim("c less than 10 points above a everywhere", "c", high=10), C.Claim("c above a on an unknown unit", "c", 0, unit="none")]


@query(f"""WITH {_GAPS}, c AS (SELECT * FROM (VALUES ('b within 8 points of a everywhere', 'b', -8, 8, NULL), ('c at least 10 points above a on F', 'c', 10, 1e9, 'F'), ('c less than 10 points above a everywhere', 'c', -1e9, 10, NULL), ('c above a on an unknown unit', 'c', 0, 1e9, 'none')) v(claim, route, low, high, one_unit))
  SELECT claim, count(points) AS units, round(min(points), 6) AS least, round(max(points), 6) AS greatest, coalesce(bool_and(round(points, 9) BETWEEN low AND high) FILTER (points IS NOT NULL), false) AS supported FROM c LEFT JOIN gaps ON c.route = gaps.route AND (one_unit IS NULL OR one_unit = grp) GROUP BY claim""")
def registered_verdicts(spark, sf_dir):
    """Claims made before a run, held against the gaps of its routes."""
    gaps = C.route_gaps(S.systems(spark, sf_dir), "grp", "item_id", "system", "a", ["b", "c"], "correct")
    return C.verdicts(gaps, "grp", CLAIMS).select("claim", "units", F.round("least", 6).alias("least"), F.round("greatest", 6).alias("greatest"), "supported")


@query()
def route_intervals(spark, sf_dir):
    found = C.route_intervals(S.systems(spark, sf_dir), "grp", "item_id", "system", "correct")
    return found.select("grp", "route", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")), "clusters")
