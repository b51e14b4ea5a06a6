"""Requests to statements to answers: validation, fan-out, a pluggable scorer, regrouping and calibrated answers.

A request row: request_id, images array<string>, question, type ('noul', 'choice', 'score'), keys array<string>,
descriptions array<string>. A scorer adds z to statement rows; it may be columns alone or a model in mapInPandas.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.functions import arrays as A
from calibra.functions import text as X

MAX_IMAGES, MAX_OPTIONS, MIN_LEVELS, MAX_LEVELS = 4, 128, 2, 10
METHODS = ("independent", "letter")
SCORE_METHODS = ("auto", "statements", "digits", "fast2", "ens4d", "jsondigits")


def problems(requests: DataFrame) -> DataFrame:
    """requests with errors: array<struct<path, message>>; an empty array is a valid request."""
    k = F.coalesce(F.size("keys"), F.lit(0))
    images = F.coalesce(F.size("images"), F.lit(0))
    rules = [
        ("images", "one to four images", ~images.between(1, MAX_IMAGES)),
        ("images", "ids must differ", F.coalesce(F.size(F.array_distinct("images")), F.lit(0)) != images),
        ("type", "unknown question type", ~F.coalesce(F.col("type").isin("noul", "choice", "score"), F.lit(False))),
        ("criteria", "2 to 128 options", (F.col("type") == "choice") & ~k.between(2, MAX_OPTIONS)),
        ("criteria", "2 to 10 levels", (F.col("type") == "score") & ~k.between(MIN_LEVELS, MAX_LEVELS)),
        ("criteria", "blank option", F.coalesce(F.exists("keys", lambda x: F.length(F.trim(x)) == 0), F.lit(False))),
    ]
    each = F.array(*(F.when(bad, F.struct(F.lit(p).alias("path"), F.lit(m).alias("message"))) for p, m, bad in rules))
    return requests.withColumn("errors", F.array_compact(each))


def fan_out(requests: DataFrame) -> DataFrame:
    """A row for each statement: one for noul, one for each option or level."""
    texts = F.when(F.col("type") == "noul", F.array("question")).otherwise(F.zip_with("keys", F.coalesce("descriptions", F.array().cast("array<string>")), lambda k, d: F.concat_ws(" ", F.col("question"), X.candidate(k, d))))
    return requests.select("request_id", "type", "keys", F.posexplode(texts).alias("pos", "statement"))


def hash_scorer(statements: DataFrame) -> DataFrame:
    """A scorer for tests: the same pseudo-logit within [-4, 4) for the same statement, everywhere."""
    h = F.conv(F.substring(F.sha2("statement", 256), 1, 8), 16, 10).cast("double")
    return statements.withColumn("z", h / float(2**32) * 8 - 4)


def answers(scored: DataFrame, temperature: float = 1.0) -> DataFrame:
    """request_id, type, answer, p array, confidence and margin (both null for noul)."""
    z = F.transform(F.array_sort(F.collect_list(F.struct("pos", "z"))), lambda s: s["z"])
    rows = scored.groupBy("request_id", "type").agg(z.alias("z"), F.first("keys").alias("keys"))
    yes = A.sigmoid(F.get("z", F.lit(0)))
    p = F.when(F.col("type") == "noul", F.array(1 - yes, yes)).otherwise(A.softmax(F.col("z"), temperature))
    rows = rows.withColumn("p", p)
    best = A.argmax(F.col("p"))
    many = F.col("type") != "noul"
    return rows.select("request_id", "type", F.when(many, F.get("keys", best)).otherwise((F.get("p", F.lit(1)) >= 0.5).cast("string")).alias("answer"), "p", F.when(many, A.entropy_confidence(F.col("p"))).alias("confidence"), F.when(many, A.margin(F.col("p"))).alias("margin"))


def decide(requests: DataFrame, scorer: Callable[[DataFrame], DataFrame] = hash_scorer, temperature: float = 1.0) -> DataFrame:
    """Valid requests answered; use `problems` for the others."""
    good = problems(requests).filter(F.size("errors") == 0).drop("errors")
    return answers(scorer(fan_out(good)), temperature)
