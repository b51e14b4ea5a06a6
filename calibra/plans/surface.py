"""Queries written in SQL alone, over the functions, views and table functions of `calibra.sql`."""
from __future__ import annotations

from calibra import sql
from calibra.plans._register import Registry
from calibra.plans.evaluation import _BINS
from calibra.sources import standins as S

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _decisions(spark, sf_dir, view: str) -> None:
    """Registers the test rows, their probabilities made by the SQL softmax."""
    sql.register_functions(spark)
    S.scores(spark, sf_dir).createOrReplaceTempView(f"{view}scores")
    probs = spark.sql(f"SELECT grp, item_id, y, calibra_softmax(z) AS p FROM {view}scores WHERE split = 'test'")
    sql.register(spark, probs, "grp", "item_id", prefix=view)


@query(f"""WITH {S.PROBS} SELECT item_id, CAST(pred AS INT) AS pred, round(conf, 6) AS conf, round(greatest(0, least(1, 1 + list_sum(list_transform(p, lambda x: x * ln(x))) / ln(5))), 6) AS entropy_conf,
  round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin, round(list_sum(list_transform(list_zip(p, [0, 1, 2, 3, 4]), lambda t: t[1] * t[2])), 6) AS expected FROM probs""")
def sql_confidences(spark, sf_dir):
    sql.register_functions(spark)
    S.scores(spark, sf_dir).createOrReplaceTempView("sql_confidences_scores")
    return spark.sql("""
      WITH probs AS (SELECT item_id, calibra_softmax(z) AS p FROM sql_confidences_scores)
      SELECT item_id, calibra_predicted(p) AS pred, round(array_max(p), 6) AS conf, round(calibra_entropy_confidence(p), 6) AS entropy_conf,
             round(calibra_margin(p), 6) AS margin, round(calibra_expected_level(p), 6) AS expected
      FROM probs""")


@query(f"""{_BINS}, e AS (SELECT grp AS unit, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece FROM bins GROUP BY grp),
  k AS (SELECT grp AS unit, row_number() OVER w AS k, avg(1 - correct) OVER (PARTITION BY grp ORDER BY c DESC, item_id ROWS UNBOUNDED PRECEDING) AS risk FROM t WINDOW w AS (PARTITION BY grp ORDER BY c DESC, item_id))
  SELECT unit, n, ece, kept FROM e JOIN (SELECT unit, coalesce(max(k) FILTER (risk <= 0.25), 0) AS kept FROM k GROUP BY unit) USING (unit)""")
def sql_ece_table(spark, sf_dir):
    _decisions(spark, sf_dir, "ece_table_")
    return spark.sql("""
      SELECT e.unit, e.n, round(e.ece, 6) AS ece, c.kept
      FROM calibra_ece_table_ece() e JOIN calibra_ece_table_coverage_at(0.25D) c ON e.unit = c.unit""")


@query(f"""WITH {S.PROBS} SELECT coalesce(grp, 'all') AS unit, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(-ln(greatest(p[y + 1], 1e-12))), 6) AS nll,
  round(avg(list_sum(list_transform(list_zip(p, [0, 1, 2, 3, 4]), lambda t: (t[1] - CAST(t[2] = y AS INT)) ** 2))), 6) AS brier,
  round(avg(abs(list_sum(list_transform(list_zip(p, [0, 1, 2, 3, 4]), lambda t: t[1] * t[2])) - y)), 6) AS mae FROM probs WHERE split = 'test' GROUP BY GROUPING SETS ((grp), ())""")
def sql_unit_metrics(spark, sf_dir):
    _decisions(spark, sf_dir, "unit_metrics_")
    return spark.sql("""
      SELECT coalesce(unit, 'all') AS unit, n, round(accuracy, 6) AS accuracy, round(nll, 6) AS nll, round(brier, 6) AS brier, round(mae, 6) AS mae
      FROM calibra_unit_metrics_metrics()""")
