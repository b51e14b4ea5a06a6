"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed over cells of source, language and topic. Raking scales the cells in turn until the token sums
of each of the three match their targets. A cell's documents are kept with the probability raked tokens / own tokens, where the
raked tokens add up to a budget (BUDGET of all tokens by default). No cell can give more than it has: cells that would
are cut to what they hold and the rest is raked again, until both hold or no mix of this size can meet the targets.
Documents are drawn by a hash of the id: the same ones on every run and at every cluster size.

Targets name values and shares. Values without a target share one (their token share by default) as `*`; targets whose
value has no token are left out and the rest scaled to 1. By default each value of the corpus is its own target, its
share raised to TEMPER. Only the cells that occur come to the driver, a row of three names and a number each, however
many documents they hold. A document without tokens counts as one. Nulls are a value of their own, written `(none)`.
Rows with the same id are kept or dropped together within a cell. An empty table gives an empty result.

The corpus has no topics; unless a column for it is given, `topic_of` tells a few apart by what a text holds: legal notices,
contact data, code, lists of figures, shouting, and prose.
"""
from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm._common import cut, table

DIMS = ("source", "lang", "topic")
ROUNDS, REFITS, TOLERANCE, BUDGET = 100, 50, 1e-6, 0.5
#: Cells up to this number go to all tasks (some MB); more are joined by a shuffle of the documents.
FEW_CELLS = 50_000
#: Shares of targets made from the corpus are raised to this power.
TEMPER = 0.7
_NONE, _REST = "(none)", "*"
#: A token: a run of letters, a run of digits, or one other mark.
TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"
LEGAL = ("licensed under", "license, version", "public license", "all rights reserved", "copyright (c)", "permission is hereby granted", "spdx-license-identifier")
CODE = ("();", "){", ") {", "};", "==", "def ", "import ", "</")


def topic_of(text: Column) -> Column:
    """A coarse topic of a whole text; the first rule that holds decides."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.octet_length(text), F.lit(1))
    share = lambda marks: (F.octet_length(text) - F.octet_length(F.translate(text, marks, ""))) / n
    holds = lambda x, parts: functools.reduce(lambda a, b: a | b, (x.contains(p) for p in parts))
    legal = holds(F.lower(text), LEGAL)
    return (
        F.when(legal, "legal").when(text.contains("@") & text.rlike(r"\S@\w[\w.-]*\.\w"), "contact").when(holds(text, CODE), "code")
        .when(share("0123456789") >= 0.2, "figures").when(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?#$%&*") >= 0.25, "loud").otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """Tokens of the whole text, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))).cast("long")


def rake(tokens: np.ndarray, index: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Shares of cells whose sums over each dimension's values are the targets, as near tokens as that allows."""
    x = tokens / tokens.sum()
    for _ in range(ROUNDS):
        moved = 0.0
        for i, t in zip(index, targets, strict=True):
            sums = np.bincount(i, x, len(t))
            f = np.divide(t, sums, out=np.ones_like(t), where=sums > 0)
            x = x * f[i]
            moved = max(moved, float(np.abs(f - 1).max()))
        if moved < TOLERANCE:
            break
    return x / x.sum()


def probabilities(names: list[list[str]], tokens: np.ndarray, targets: dict[str, dict[str, float]], budget: float = BUDGET, temper: float = TEMPER) -> np.ndarray:
    """The keeping probability of each cell. names: the cells' values in each dimension; no targets: those of the corpus, tempered."""
    tokens = np.asarray(tokens, np.float64)
    index, goals = [], []
    for dim, column in zip(DIMS, names, strict=True):
        values, at = np.unique(np.asarray(column, object), return_inverse=True)
        own = np.bincount(at, tokens, len(values)) / tokens.sum()
        if dim not in targets:
            goal = own**temper
        else:
            goal = np.array([targets[dim].get(v, np.nan) for v in values])
            rest = np.isnan(goal)
            goal[rest] = targets[dim].get(_REST, own[rest].sum()) * own[rest] / max(own[rest].sum(), 1e-300)
        index.append(at)
        goals.append(goal / goal.sum())
    wanted, kept = budget * tokens.sum(), tokens
    for _ in range(REFITS):
        raked = rake(kept, index, goals) * wanted
        kept = np.minimum(raked, tokens)
        if kept.sum() >= wanted * (1 - TOLERANCE):
            break
    return kept / tokens


def _named(targets: dict[str, dict[str, float]], topic: Column) -> list[Column]:
    """The cell of a row; values that a given target does not name are one."""
    value = {"source": F.coalesce(F.col("source").cast("string"), F.lit(_NONE)), "lang": F.coalesce(F.col("lang").cast("string"), F.lit(_NONE)), "topic": F.coalesce(topic, F.lit(_NONE))}
    return [F.when(value[d].isin([v for v in targets[d] if v != _REST]), value[d]).otherwise(F.lit(_REST)) if d in targets else value[d] for d in DIMS]


def _cells(slim: DataFrame, keys: list[str], targets: dict[str, dict[str, float]], budget: float, temper: float) -> DataFrame:
    """One row for each cell that occurs: its values and keeping probability."""
    spark = slim.sparkSession
    sums = slim.groupBy(*keys).agg(F.sum("tokens").alias("tokens")).toArrow()
    schema = ", ".join(f"`{k}` string" for k in keys) + ", probability double"
    if not sums.num_rows:
        return spark.createDataFrame([], schema)
    names = [sums[k].to_pylist() for k in keys]
    p = probabilities(names, np.asarray(sums["tokens"]), targets, budget, temper)
    cells = spark.createDataFrame(list(zip(*names, p.tolist(), strict=True)), schema)
    return F.broadcast(cells) if sums.num_rows <= FEW_CELLS else cells


def _drawn() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 52)) / float(1 << 52)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, budget: float = BUDGET, temper: float = TEMPER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, kept for each row of docs."""
    targets = targets or {}
    named = [F.coalesce(F.col(c).cast("string"), F.lit(_NONE)).alias(c) for c in ("source", "lang")]
    slim = cut(docs.select(F.col(doc_id).alias("doc_id"), *named, F.coalesce(topic_of(F.col(text)) if topic is None else topic, F.lit(_NONE)).alias("topic"), tokens_of(F.col(text)).alias("tokens")))
    keys = [f"_{d}" for d in DIMS]
    keyed = slim.select("*", *(c.alias(k) for k, c in zip(keys, _named(targets, F.col("topic")), strict=True)))
    cells = _cells(keyed, keys, targets, budget, temper)
    placed = keyed.join(cells, keys, "left")
    return placed.select("doc_id", *DIMS, "tokens", "probability", (_drawn() < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, budget: float = BUDGET, temper: float = TEMPER) -> DataFrame:
    """The kept rows of docs, with their own columns."""
    targets = targets or {}
    names = [f"_cell_{d}" for d in DIMS]
    while {*names, "_" + names[0]} & set(docs.columns):
        names = [f"_{n}" for n in names]
    keys = [c.alias(n) for n, c in zip(names, _named(targets, topic_of(F.col("text")) if topic is None else topic), strict=True)]
    cells = _cells(docs.select(*keys, tokens_of(F.col("text")).alias("tokens")), names, targets, budget, temper).withColumnRenamed("probability", "_" + names[0])
    placed = docs.select("*", *keys).join(cells, names)
    return placed.filter(_drawn() < F.col("_" + names[0])).select(*docs.columns)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op8_source_mixing": op8_source_mixing}
ORACLES: dict[str, str] = {}
