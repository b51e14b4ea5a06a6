"""Metrics of decisions and of calls."""
from __future__ import annotations

from pyspark.sql import functions as F

from calibra.functions import arrays as A
from calibra.operators import metrics as M
from calibra.operators import resample
from calibra.operators.quantiles import quantiles
from calibra.plans._register import Registry
from calibra.plans.scoring import probs
from calibra.sources import standins as S

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
_TEST = f"WITH {S.PROBS}, t AS (SELECT *, round(conf, 9) AS c FROM probs WHERE split = 'test')"


def _test(spark, sf_dir):
    return probs(spark, sf_dir).filter("split = 'test'").withColumn("c", F.round("conf", 9))


@query(f"""{_TEST} SELECT grp, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(-ln(greatest(p[y + 1], 1e-12))), 6) AS nll,
  round(avg(list_sum(list_transform(list_zip(p, [0, 1, 2, 3, 4]), lambda t: (t[1] - CAST(t[2] = y AS INT)) ** 2))), 6) AS brier,
  round(avg(abs(list_sum(list_transform(list_zip(p, [0, 1, 2, 3, 4]), lambda t: t[1] * t[2])) - y)), 6) AS mae, round(avg(CAST(abs(pred - y) <= 1 AS INT)), 6) AS within_one FROM t GROUP BY grp""")
def metric_bundle(spark, sf_dir):
    b = M.bundle(_test(spark, sf_dir), ["grp"], "p", "y")
    return b.select("grp", "n", *(F.round(c, 6).alias(c) for c in ("accuracy", "nll", "brier", "mae", "within_one")))


@query(f"""WITH {S.NOULS}, p AS (SELECT *, least(greatest(1 / (1 + exp(-z)), 1e-12), 1 - 1e-12) AS p FROM nouls WHERE split = 'test')
  SELECT grp, count(*) AS n, round(avg(CAST((p >= 0.5) = (y = 1) AS INT)), 6) AS accuracy, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS nll, round(avg((p - y) ** 2), 6) AS brier FROM p GROUP BY grp""")
def noul_metrics(spark, sf_dir):
    p, y = F.least(F.greatest(A.sigmoid(F.col("z")), F.lit(1e-12)), F.lit(1 - 1e-12)), F.col("y")
    rows = S.nouls(spark, sf_dir).filter("split = 'test'").withColumn("p", p)
    p = F.col("p")
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg(((p >= 0.5) == (y == 1)).cast("double")), 6).alias("accuracy"), F.round(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))), 6).alias("nll"), F.round(F.avg((p - y) * (p - y)), 6).alias("brier"))


_BINS = f"""{_TEST}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY c, item_id) - 1 AS r, count(*) OVER (PARTITION BY grp) AS m FROM t),
  q AS (SELECT *, least(15, m) AS b, m // least(15, m) AS s, m % least(15, m) AS x FROM r),
  bins AS (SELECT grp, CAST(CASE WHEN r < x * (s + 1) THEN r // (s + 1) ELSE x + (r - x * (s + 1)) // s END AS INT) AS bin, avg(c) AS confidence, avg(correct) AS accuracy, count(*) AS n FROM q GROUP BY 1, 2)"""


@query(f"{_BINS} SELECT grp, bin, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, n FROM bins")
def reliability_bins(spark, sf_dir):
    return M.reliability(_test(spark, sf_dir), ["grp"], "c", "correct", "item_id").select("grp", "bin", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"), "n")


@query(f"{_BINS} SELECT grp, round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece FROM bins GROUP BY grp")
def ece_equal_mass(spark, sf_dir):
    return M.ece(_test(spark, sf_dir), ["grp"], "c", "correct", "item_id").select("grp", F.round("ece", 6).alias("ece"))


@query(f"""{_TEST}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY c DESC, item_id) AS r, count(*) OVER (PARTITION BY grp) AS m FROM t)
  SELECT grp, {", ".join(f"round(avg(correct) FILTER (r <= greatest(1, round_even({c} / 100::DOUBLE * m, 0))), 6) AS acc_at_{c}" for c in M.COVERAGES)} FROM r GROUP BY grp""")
def selective_accuracy(spark, sf_dir):
    s = M.selective(_test(spark, sf_dir), ["grp"], "c", "correct", "item_id")
    return s.select("grp", *(F.round(f"acc_at_{c}", 6).alias(f"acc_at_{c}") for c in M.COVERAGES))


@query(f"{_TEST} SELECT grp, item_id, row_number() OVER w AS k, round(avg(1 - correct) OVER (PARTITION BY grp ORDER BY c DESC, item_id ROWS UNBOUNDED PRECEDING), 6) AS risk FROM t WINDOW w AS (PARTITION BY grp ORDER BY c DESC, item_id)")
def risk_coverage(spark, sf_dir):
    r = M.risk_coverage(_test(spark, sf_dir), ["grp"], "c", "correct", "item_id")
    return r.select("grp", "item_id", F.col("k").cast("long").alias("k"), F.round("risk", 6).alias("risk"))


@query(f"""WITH {S.NOULS}, r AS (SELECT grp, y, rank() OVER (PARTITION BY grp ORDER BY z) + (count(*) OVER (PARTITION BY grp, z) - 1) / 2::DOUBLE AS r FROM nouls)
  SELECT grp, round((sum(r) FILTER (y = 1) - (sum(y) * (sum(y) + 1)) / 2::DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auroc FROM r GROUP BY grp""")
def auroc(spark, sf_dir):
    return M.auroc(S.nouls(spark, sf_dir), ["grp"], "z", "y").select("grp", F.round("auroc", 6).alias("auroc"))


@query(f"""{_TEST}, l AS (SELECT grp, y AS k, CAST(correct AS BIGINT) AS tp, 1 AS t, 0 AS p FROM t UNION ALL SELECT grp, pred, 0, 0, 1 FROM t), f AS (SELECT grp, k, 2.0::DOUBLE * sum(tp) / (sum(t) + sum(p)) AS f FROM l GROUP BY grp, k)
  SELECT grp, round(avg(f), 6) AS macro_f1 FROM f GROUP BY grp""")
def macro_f1(spark, sf_dir):
    return M.macro_f1(_test(spark, sf_dir), ["grp"], "pred", "y").select("grp", F.round("macro_f1", 6).alias("macro_f1"))


@query(f"""{_TEST}, e AS (SELECT grp, y, round(list_sum(list_transform(list_zip(p, [0, 1, 2, 3, 4]), lambda t: t[1] * t[2])), 9) AS e FROM t),
  r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY e) + (count(*) OVER (PARTITION BY grp, e) - 1) / 2::DOUBLE AS re, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2::DOUBLE AS ry FROM e)
  SELECT grp, round(corr(e, y), 6) AS pearson, round(corr(re, ry), 6) AS spearman FROM r GROUP BY grp""")
def rank_correlation(spark, sf_dir):
    rows = _test(spark, sf_dir).withColumn("e", F.round(A.expected_level(F.col("p")), 9))
    return M.correlations(rows, ["grp"], "e", "y").select("grp", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query(f"{_TEST} SELECT grp, y, {', '.join(f'count(*) FILTER (pred = {j}) AS pred_{j}' for j in range(5))} FROM t GROUP BY grp, y")
def confusion_matrix(spark, sf_dir):
    return M.confusion(_test(spark, sf_dir), ["grp"], "pred", "y", 5)


@query(f"""{_TEST}, c AS (SELECT grp, y, CAST(pred AS INT) AS pred, count(*) AS n, min(item_id) AS first_seen FROM t WHERE correct = 0 GROUP BY 1, 2, 3)
  SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY n DESC, first_seen) AS INT) AS rank FROM c QUALIFY rank <= 3""")
def top_confusions(spark, sf_dir):
    return M.top_confusions(_test(spark, sf_dir), ["grp"], "pred", "y", "item_id")


@query(f"{_TEST} SELECT grp, item_id, round(c, 6) AS conf, CAST(row_number() OVER (PARTITION BY grp ORDER BY c DESC, item_id) AS INT) AS rank FROM t WHERE correct = 0 QUALIFY rank <= 20")
def confident_errors(spark, sf_dir):
    return M.confident_errors(_test(spark, sf_dir), ["grp"], "c", "correct", "item_id").select("grp", "item_id", F.round("c", 6).alias("conf"), "rank")


@query(f"WITH {S.CALLS} SELECT event_type, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.9), 6) AS p90, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(min(latency_ms), 6) AS lo, round(max(latency_ms), 6) AS hi, round(avg(latency_ms), 6) AS mean FROM calls GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    calls = S.calls(spark, sf_dir)
    found = quantiles(calls, ["event_type"], "latency_ms", [0.5, 0.9, 0.95])
    mean = calls.groupBy("event_type").agg(F.avg("latency_ms").alias("mean"))
    return found.join(mean, "event_type").select("event_type", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p50", "p90", "p95"))), *(F.round(c, 6).alias(c) for c in ("lo", "hi", "mean")))


@query(f"WITH {S.CALLS} SELECT event_type, round(count(*) / nullif(sum(latency_ms) / 1000, 0), 6) AS per_second, round(avg(CASE WHEN tokens > 0 THEN tokens END), 6) AS mean_tokens FROM calls GROUP BY 1")
def throughput(spark, sf_dir):
    t = F.when(F.col("tokens") > 0, F.col("tokens"))
    return S.calls(spark, sf_dir).groupBy("event_type").agg(F.round(F.try_divide(F.count("*"), F.sum("latency_ms") / 1000), 6).alias("per_second"), F.round(F.avg(t), 6).alias("mean_tokens"))


@query(f"WITH {S.CALLS} SELECT CAST(ts AS DATE) AS day, count(*) AS attempted, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE <= 0.02 AS valid FROM calls GROUP BY 1")
def failure_rate(spark, sf_dir):
    bad = F.count_if(F.col("event_type") == "error")
    return S.calls(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("attempted"), bad.alias("failed"), (bad / F.count("*") <= 0.02).alias("valid"))


@query(f"{_TEST}, g AS (SELECT grp, avg(correct) AS a FROM t GROUP BY grp) SELECT round(avg(a), 6) AS macro, (SELECT round(avg(correct), 6) FROM t) AS pooled FROM g")
def macro_over_groups(spark, sf_dir):
    per = _test(spark, sf_dir).groupBy("grp").agg(F.avg("correct").alias("a"), F.sum("correct").alias("s"), F.count("*").alias("n"))
    return per.agg(F.round(F.avg("a"), 6).alias("macro"), F.round(F.sum("s") / F.sum("n"), 6).alias("pooled"))


@query(f"{_TEST} SELECT grp, y, count(*) AS n, round(avg(correct), 6) AS accuracy FROM t GROUP BY GROUPING SETS ((grp, y), (grp), ())")
def breakdown_grouping_sets(spark, sf_dir):
    _test(spark, sf_dir).createOrReplaceTempView("_breakdown")
    return spark.sql("SELECT grp, y, count(*) AS n, round(avg(correct), 6) AS accuracy FROM _breakdown GROUP BY GROUPING SETS ((grp, y), (grp), ())")


@query(f"""{_BINS}, e AS (SELECT grp, sum(n * abs(confidence - accuracy)) / sum(n) AS ece FROM bins GROUP BY grp), a AS (SELECT grp, 0.9::DOUBLE - avg(correct) AS gap FROM t GROUP BY grp)
  SELECT grp, round(gap, 6) AS gap, round(ece, 6) AS ece, CASE WHEN gap > 0.05 OR ece > 0.05 THEN 'NO-GO' ELSE 'PARTIAL' END AS verdict FROM a JOIN e USING (grp)""")
def go_no_go(spark, sf_dir):
    t = _test(spark, sf_dir)
    m = M.ece(t, ["grp"], "c", "correct", "item_id").join(t.groupBy("grp").agg((F.lit(0.9) - F.avg("correct")).alias("gap")), "grp")
    made = M.go_no_go(m.withColumn("failures", F.lit(None).cast("double")).withColumn("latency_ms", F.lit(None).cast("double")))
    return made.select("grp", F.round("gap", 6).alias("gap"), F.round("ece", 6).alias("ece"), "verdict")


@query(f"""{_BINS}, e AS (SELECT grp, sum(n * abs(confidence - accuracy)) / sum(n) AS ece FROM bins GROUP BY grp), a AS (SELECT grp, 1 - avg(correct) AS err FROM t GROUP BY grp)
  SELECT grp, round(err, 6) AS err, ece > 0.05 AS over_gate, CAST(row_number() OVER (ORDER BY round(ece, 9) DESC NULLS LAST, round(err, 9) DESC, grp) AS INT) AS place FROM a JOIN e USING (grp)""")
def error_breakdown(spark, sf_dir):
    from pyspark.sql import Window

    t = _test(spark, sf_dir)
    m = M.ece(t, ["grp"], "c", "correct", "item_id").join(t.groupBy("grp").agg((1 - F.avg("correct")).alias("err")), "grp")
    place = F.row_number().over(Window.orderBy(F.round("ece", 9).desc_nulls_last(), F.round("err", 9).desc(), "grp"))  # a row for each group
    return m.select("grp", F.round("err", 6).alias("err"), (F.col("ece") > 0.05).alias("over_gate"), place.alias("place"))


@query(f"WITH {S.CALLS} SELECT event_type, round(1000 * sum(tokens) * 0.000002::DOUBLE / count(*), 6) AS per_1000_tokens, CAST(sum(tokens // 4) AS BIGINT) AS quarters, round(sum(latency_ms) / 3600000 * 1.2::DOUBLE, 6) AS rented FROM calls GROUP BY 1")
def cost_model(spark, sf_dir):
    return S.calls(spark, sf_dir).groupBy("event_type").agg(F.round(1000 * F.sum("tokens") * F.lit(0.000002) / F.count("*"), 6).alias("per_1000_tokens"), F.sum(F.expr("tokens div 4")).alias("quarters"), F.round(F.sum("latency_ms") / 3600000 * 1.2, 6).alias("rented"))


@query(f"""{_TEST}, f AS (SELECT *, CASE WHEN grp = 'O' AND item_id % 3 = 0 THEN NULL ELSE conf END AS cal FROM t), g AS (SELECT grp, bool_and(cal IS NOT NULL) AS whole FROM f GROUP BY grp)
  SELECT grp, whole, round(avg(CASE WHEN whole THEN cal ELSE c END), 6) AS mean_conf FROM f JOIN g USING (grp) GROUP BY grp, whole""")
def best_of_field(spark, sf_dir):
    f = _test(spark, sf_dir).withColumn("cal", F.when((F.col("grp") == "O") & (F.col("item_id") % 3 == 0), None).otherwise(F.col("conf")))
    whole = f.groupBy("grp").agg(F.every(F.col("cal").isNotNull()).alias("whole"))
    return f.join(F.broadcast(whole), "grp").groupBy("grp", "whole").agg(F.round(F.avg(F.when(F.col("whole"), F.col("cal")).otherwise(F.col("c"))), 6).alias("mean_conf"))


@query(f"WITH {S.SYSTEMS}, a AS (SELECT item_id, count(*) AS n, bool_or(correct) AS any_right, bool_and(correct) AS all_right FROM systems GROUP BY item_id HAVING count(*) = 3) SELECT count(*) AS items, count(*) FILTER (NOT any_right) AS none_right, count(*) FILTER (all_right) AS all_right FROM a")
def all_wrong_share(spark, sf_dir):
    a = S.systems(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"), F.bool_or("correct").alias("any_right"), F.every("correct").alias("whole")).filter("n = 3")
    return a.agg(F.count("*").alias("items"), F.count_if(~F.col("any_right")).alias("none_right"), F.count_if("whole").alias("all_right"))


@query(f"WITH {S.SYSTEMS} SELECT grp, round(avg(CAST(correct AS INT)) FILTER (system = 'a'), 6) AS a, round(avg(CAST(correct AS INT)) FILTER (system = 'b'), 6) AS b, round(avg(CAST(correct AS INT)) FILTER (system = 'c'), 6) AS c FROM systems GROUP BY grp")
def comparison_matrix(spark, sf_dir):
    return S.systems(spark, sf_dir).groupBy("grp").pivot("system", ["a", "b", "c"]).agg(F.round(F.avg(F.col("correct").cast("int")), 6))


#: Draws of the query.
_DRAWS = 50


@query(f"""{_BINS}, b AS (SELECT grp, item_id, c, CASE WHEN r < x * (s + 1) THEN r // (s + 1) ELSE x + (r - x * (s + 1)) // s END AS bin FROM q),
  d AS (SELECT grp, bin, c, draw, {S.uniform_sql("item_id", "draw")} < c AS hit FROM (SELECT *, unnest(range({_DRAWS})) AS draw FROM b)),
  s AS (SELECT grp, draw, bin, abs(sum(c) - sum(CAST(hit AS INT))) AS off, count(*) AS n FROM d GROUP BY ALL), e AS (SELECT grp, draw, sum(off) / sum(n) AS ece FROM s GROUP BY ALL)
  SELECT grp, round(avg(ece), 6) AS ece_floor FROM e GROUP BY grp""")
def ece_noise_floor(spark, sf_dir):
    rows = _test(spark, sf_dir).select("grp", "item_id", "c")
    floor = resample.ece_floor(M.binned(rows, ["grp"], "c", "item_id"), ["grp"], "c", "item_id", _DRAWS, S.uniform)
    return floor.select("grp", F.round("ece_floor", 6).alias("ece_floor"))


@query()
def bootstrap_ci(spark, sf_dir):
    return resample.cluster_bootstrap(_test(spark, sf_dir), "grp", "item_id", "correct")


@query()
def cluster_bootstrap(spark, sf_dir):
    return resample.cluster_bootstrap(_test(spark, sf_dir).withColumn("photo", F.expr("item_id div 10")), "grp", "photo", "correct")


@query()
def paired_difference(spark, sf_dir):
    both = S.systems(spark, sf_dir).groupBy("grp", "item_id").pivot("system", ["a", "b"]).agg(F.first(F.col("correct").cast("int"))).dropna()
    return resample.cluster_bootstrap(both, "grp", "item_id", "a", "b")


@query()
def stratified_difference(spark, sf_dir):
    """The difference of two systems over resampled photos of ten items, each status resampled by itself; a verdict by the interval's sign."""
    both = S.systems(spark, sf_dir).groupBy("grp", "item_id").pivot("system", ["a", "b"]).agg(F.first(F.col("correct").cast("int"))).dropna()
    pooled = both.withColumns({"all": F.lit("all"), "photo": F.concat_ws("/", "grp", F.expr("item_id div 10").cast("string"))})
    found = resample.cluster_bootstrap(pooled, "all", "photo", "a", "b", stratum="grp")
    verdict = F.when(F.col("low") > 0, "above").when(F.col("high") < 0, "below").when((F.col("low") > -0.03) & (F.col("high") < 0.03), "equal").otherwise("open")
    return found.withColumn("verdict", verdict)
