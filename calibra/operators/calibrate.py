"""Calibration of prediction rows: fits pooled by question type and by suite, their application, and the choice of a method.

Prediction rows: key (configuration), suite, type ('noul', 'choice', 'score'), split, z array<double>, label_index.
A set of fits has a row for each key and scope: ('type', question type) pooled over suites, and ('suite', suite).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.functions import arrays as A
from calibra.operators import fits, metrics

#: Score methods in the order that a labelled fit, and one without labels, is preferred; what is asked with neither (fixed values).
LABELED_ORDER = ("ens4d", "fast2", "digits", "jsondigits")
UNLABELED_ORDER = ("jsondigits", "ens4d", "fast2", "digits")
ZERO_SHOT = "jsondigits"
UNLABELED_KIND = "unlabeled_zscore"
LEAST_UNLABELED = 8


def probability_rows(rows: DataFrame) -> DataFrame:
    """Rows with logits: hosted systems give only whether they were right."""
    return rows.filter(F.col("z").isNotNull())


def hit() -> Column:
    """Whether a prediction row is right: the flag of a hosted row, p >= 0.5 for yes/no, else the largest option."""
    raw = F.col("raw")
    local = F.when(F.col("type") == "noul", (F.get(raw, F.lit(0)) >= 0.5) == (F.col("label_index") == 1)).otherwise(A.argmax(raw) == F.col("label_index"))
    return F.when(F.col("z").isNull(), F.col("correct")).otherwise(local)


def prediction_rows(answers: DataFrame, run_id: str) -> DataFrame:
    """answers: suite, item_id, split, backend, method, type, keys, label, z, picked. One wide row an item.

    The suite of human_gold is split by type; label_index is 0 or 1, the place of the label among the keys, or the level;
    a row without z is a hosted one and keeps only whether its pick was right.
    """
    kind, label = F.col("type"), F.col("label")
    index = F.when(kind == "noul", (label == "true").cast("int")).when(kind == "choice", F.array_position("keys", label).cast("int") - 1).otherwise(F.expr("try_cast(label AS int)"))
    raw = F.when(F.col("z").isNull(), None).when(kind == "noul", F.array(A.sigmoid(F.get("z", F.lit(0))))).otherwise(A.softmax(F.col("z")))
    made = answers.withColumns({
        "run_id": F.lit(run_id), "suite": F.when(F.col("suite") == "human_gold", F.concat_ws("/", "suite", "type")).otherwise(F.col("suite")), "label_index": index, "raw": raw,
        "choice_method": F.when(~F.col("method").isin("statement", "pick"), F.col("method")), "n_options": F.nullif(F.size("keys"), F.lit(0)),
    })
    made = made.withColumn("correct", F.when(F.col("z").isNull(), F.col("picked") == F.col("label_index")))
    return made.withColumn("hit", hit()).drop("picked")


def _scopes(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Each row under its question type and under its suite."""
    scope = F.array(F.struct(F.lit("type").alias("scope"), F.col("type").alias("name")), F.struct(F.lit("suite").alias("scope"), F.col("suite").alias("name")))
    return rows.select("key", "type", *keep, F.explode(scope).alias("s")).select("key", "s.scope", "s.name", "type", *keep)


_UNIT = ["key", "scope", "name"]


def _unit() -> Column:
    return F.concat_ws("\x1f", *_UNIT)


def fit_sets(rows: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """key, scope, name, type, method, a, b (Platt of yes/no) or temperature (the rest), from calibration rows.

    grid: log temperatures to choose from, instead of bracketing steps.
    """
    scoped = _scopes(probability_rows(rows).filter("split = 'calibration'"), ["z", "label_index"]).withColumn("unit", _unit())
    yes_no = scoped.filter("type = 'noul'").withColumn("z0", F.get("z", F.lit(0)))
    many = scoped.filter("type <> 'noul'")
    platt = fits.fit_logistic(yes_no, "unit", ["z0"], "label_index").select("unit", F.lit("platt").alias("method"), F.col("w")[0].alias("a"), F.col("w")[1].alias("b"), F.lit(None).cast("double").alias("temperature"))
    warm = fits.grid_temperature(many, "unit", "z", "label_index", grid) if grid else fits.fit_temperature(many, "unit", "z", "label_index")
    warm = warm.select("unit", F.lit("temperature").alias("method"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"), "temperature")
    units = scoped.groupBy("unit", *_UNIT).agg(F.min("type").alias("type"), F.count("*").alias("n"))
    return units.join(platt.unionByName(warm), "unit").drop("unit")


def calibrated(z: Column, kind: Column, a: Column, b: Column, temperature: Column) -> Column:
    """Probabilities under a fit: (1 - p, p) of yes/no, softmax of the rest; null without parameters."""
    yes = A.sigmoid(a * F.get(z, F.lit(0)) + b)
    return F.when((kind == "noul") & a.isNotNull(), F.array(1 - yes, yes)).when((kind != "noul") & temperature.isNotNull(), A.softmax(z, temperature))


def apply_sets(rows: DataFrame, sets: DataFrame, prefer_suite: bool = False) -> DataFrame:
    """rows with p, fit_scope: by the pooled fit of the key and type, or by the suite's own where asked for and there is one.

    A key or type without a fit leaves p and fit_scope null: parameters of another configuration never apply.
    """
    fields = ["a", "b", "temperature"]
    pooled = sets.filter("scope = 'type'").select("key", F.col("name").alias("type"), F.struct(*fields).alias("_t"))
    own = sets.filter("scope = 'suite'").select("key", F.col("name").alias("suite"), "type", F.struct(*fields).alias("_s"))
    joined = rows.join(pooled, ["key", "type"], "left").join(own, ["key", "suite", "type"], "left")
    first, second = ("_s", "_t") if prefer_suite else ("_t", "_t")
    f = F.coalesce(first, second)
    p = calibrated(F.col("z"), F.col("type"), f["a"], f["b"], f["temperature"])
    scope = F.when(F.col(first).isNotNull(), "suite" if prefer_suite else "type").when(F.col(second).isNotNull(), "type")
    return joined.withColumns({"p": p, "fit_scope": scope}).drop("_t", "_s")


def quality(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """sets with n, nll_before, nll_after, ece_before, ece_after on the calibration rows; rows need an item_id."""
    scoped = _scopes(probability_rows(rows).filter("split = 'calibration'"), ["item_id", "z", "label_index"])
    joined = scoped.join(sets.select(*_UNIT, "a", "b", "temperature"), _UNIT)
    one = F.lit(1.0)
    made = joined.select(*_UNIT, "item_id", "label_index", calibrated(F.col("z"), F.col("type"), one, F.lit(0.0), one).alias("p0"), calibrated(F.col("z"), F.col("type"), F.col("a"), F.col("b"), F.col("temperature")).alias("p1"))
    sides = made.select(*_UNIT, "item_id", "label_index", F.inline(F.array(F.struct(F.lit("before").alias("side"), F.col("p0").alias("p")), F.struct(F.lit("after").alias("side"), F.col("p1").alias("p")))))
    scored = sides.select(*_UNIT, "item_id", "side", F.round(A.top(F.col("p")), 9).alias("conf"), (A.argmax(F.col("p")) == F.col("label_index")).cast("int").alias("correct"), A.nll(F.col("p"), F.col("label_index")).alias("nll"))
    unit = [*_UNIT, "side"]
    both = scored.groupBy(*unit).agg(F.avg("nll").alias("nll")).join(metrics.ece(scored, unit, "conf", "correct", "item_id"), unit)
    wide = both.groupBy(*_UNIT).agg(*(F.max(F.when(F.col("side") == s, F.col(m))).alias(f"{m}_{s}") for m in ("nll", "ece") for s in ("before", "after")))
    return sets.join(wide, _UNIT)


def auto_method(rubrics: DataFrame, fitted: DataFrame) -> DataFrame:
    """rubrics (rubric, wanted) with score_method: that of the first labelled fit, else of the first without labels, else none's.

    fitted: rubric, score_method, kind. Without `wanted` no fit counts.
    """
    order = [(m, False, i) for i, m in enumerate(LABELED_ORDER)] + [(m, True, len(LABELED_ORDER) + i) for i, m in enumerate(UNLABELED_ORDER)]
    place = F.coalesce(*(F.when((F.col("score_method") == m) & ((F.col("kind") == UNLABELED_KIND) == unlabeled), i) for m, unlabeled, i in order))
    best = fitted.withColumn("_place", place).filter("_place is not null").groupBy("rubric").agg(F.min_by("score_method", "_place").alias("_best"))
    return rubrics.join(best, "rubric", "left").withColumn("score_method", F.coalesce(F.when(F.col("wanted"), F.col("_best")), F.lit(ZERO_SHOT))).drop("_best")


def unlabeled_readout(df: DataFrame, unit: list[str], members: str) -> DataFrame:
    """df with z: member logits (array of arrays) standardized over their pool, then averaged; pools under LEAST_UNLABELED give null."""
    flat = df.withColumn("_flat", F.flatten(members))
    n = df.groupBy(*unit).agg(F.count("*").alias("_n"))
    made = fits.standardize(flat, unit, "_flat").join(n, unit)
    levels = F.size(F.get(members, F.lit(0)))
    back = F.transform(F.sequence(F.lit(0), F.size(members) - 1), lambda m: F.slice("x", m * levels + 1, levels))
    return made.withColumn("z", F.when(F.col("_n") >= LEAST_UNLABELED, A.mean_of(back))).drop("_flat", "_n", "x")
