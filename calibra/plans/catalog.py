"""All queries over the reference tables, with their SQL twins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calibra.plans import calibration, contrasts, decisions, evaluation, joins, learning, prompts, reports, scoring, suites, surface

_PARTS = (scoring, evaluation, joins, prompts, decisions, learning, calibration, reports, contrasts, suites, surface)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in _PARTS for k, v in p.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.dual_encoder_choice(spark, sf_dir)
