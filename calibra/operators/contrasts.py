"""Contrasts between runs on the same items: budgets, planted variants, open sets, defects of a test, control routes.

Every contrast puts an item's answers side by side by one aggregation over (unit, item), which tasks start before the shuffle, so
an item with many repeated rows costs no more than others. Budgets, systems and routes are short lists given by the
caller. A null unit is a unit of its own; rows without an item, and answers that are null, count as not given; of repeated
answers the smallest (a wrong one) counts. An empty table gives no rows.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.functions import arrays as A
from calibra.operators import metrics, newton
from calibra.operators.quantiles import quantiles
from calibra.operators.resample import cluster_bootstrap, ece_floor, hashed_uniform
from calibra.sources.scratch import cut


def side_by_side(rows: DataFrame, unit: list[str], item: str, variant: str, variants: list, values: list[str]) -> DataFrame:
    """unit, item and a struct `v0`, `v1`, ... of the values of each variant; null where a variant or one of its values is missing."""
    value = F.struct(*(F.col(v).alias(v) for v in values))
    given = F.lit(True)
    for v in values:
        given = given & F.col(v).isNotNull()
    own = [F.min(F.when((F.col(variant) == F.lit(name)) & given, value)).alias(f"v{i}") for i, name in enumerate(variants)]
    return rows.filter(F.col(item).isNotNull() & F.col(variant).isin(*variants)).groupBy(*unit, item).agg(*own)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An outer join whose null keys meet; right's columns follow."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(right.withColumnsRenamed({k: f"_{k}" for k in keys}), same, "left").drop(*(f"_{k}" for k in keys))


def budget_sweep(rows: DataFrame, unit: list[str], item: str, budget: str, budgets: list, correct: str, tokens: str, latency: str) -> DataFrame:
    """unit, budget, n, accuracy, tokens, p50, gain, gained, lost: each budget on the items that every budget has answered.

    gain, gained and lost compare an item's answer with its own under the first budget.
    """
    wide = side_by_side(rows, unit, item, budget, budgets, [correct, latency, tokens]).dropna(subset=[f"v{i}" for i in range(len(budgets))])
    each = F.array(*(F.struct(F.lit(b).alias("budget"), F.col(f"v{i}")[correct].cast("int").alias("c"), F.col(f"v{i}")[tokens].cast("double").alias("t"), F.col(f"v{i}")[latency].cast("double").alias("l")) for i, b in enumerate(budgets)))
    long = wide.select(*unit, F.col("v0")[correct].cast("int").alias("first"), F.explode(each).alias("e")).select(*unit, "first", "e.*")
    more = F.col("c") - F.col("first")
    found = long.groupBy(*unit, "budget").agg(F.count("*").alias("n"), F.avg("c").alias("accuracy"), F.avg("t").alias("tokens"), F.avg(more).alias("gain"), F.count_if(more > 0).alias("gained"), F.count_if(more < 0).alias("lost"))
    middle = quantiles(long, [*unit, "budget"], "l", [0.5]).select(*unit, "budget", F.col("q")[0].alias("p50"))
    return _joined(found, middle, [*unit, "budget"]).select(*unit, "budget", "n", "accuracy", "tokens", "p50", "gain", "gained", "lost")


def paired_flips(rows: DataFrame, unit: list[str], pair: str, variant: str, z: str, clean: str = "clean", changed: str = "injected") -> DataFrame:
    """What a planted instruction does to yes/no answers (yes: z >= 0), over pairs with both variants.

    unit, pairs, clean_yes, changed_yes, flipped (no, then yes), flip_rate (of the clean no; null without one), mean, median and greatest
    shift of z.
    """
    wide = side_by_side(rows, unit, pair, variant, [clean, changed], [z]).dropna(subset=["v0", "v1"])
    both = wide.select(*unit, F.col("v0")[z].alias("a"), F.col("v1")[z].alias("b"), (F.col("v1")[z] - F.col("v0")[z]).alias("shift"))
    no, yes = F.col("a") < 0, F.col("b") >= 0
    found = both.groupBy(*unit).agg(F.count("*").alias("pairs"), F.count_if(~no).alias("clean_yes"), F.count_if(yes).alias("changed_yes"), F.count_if(no & yes).alias("flipped"), F.try_divide(F.count_if(no & yes), F.count_if(no)).alias("flip_rate"), F.avg("shift").alias("mean_shift"), F.max("shift").alias("max_shift"))
    middle = quantiles(both, unit, "shift", [0.5]).select(*unit, F.col("q")[0].alias("median_shift"))
    return _joined(found, middle, unit)


def open_set(rows: DataFrame, unit: list[str], p: str, y: str, other: Column) -> DataFrame:
    """How items of options that were held out land on `other` (its index), and how many known items it draws away.

    unit, held, held_other, known, known_accuracy, known_other, p_other_held, p_other_known; shares are null without items.
    """
    landed, out, share = A.argmax(F.col(p)) == other, F.col(y) == other, F.get(p, other.cast("int"))
    mean = lambda where, c: F.avg(F.when(where, c.cast("double")))
    return rows.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*unit).agg(
        F.count_if(out).alias("held"), mean(out, landed).alias("held_other"), F.count_if(~out).alias("known"), mean(~out, A.argmax(F.col(p)) == F.col(y)).alias("known_accuracy"),
        mean(~out, landed).alias("known_other"), mean(out, share).alias("p_other_held"), mean(~out, share).alias("p_other_known"),
    )


def yes_rates(rows: DataFrame, unit: str, part: Column, y: str, raw: str, calibrated: str) -> DataFrame:
    """unit, part (null: the whole unit), n, and the rates of yes and of right answers before and after calibration."""
    yes = lambda c: (F.col(c) >= 0.5).cast("int")
    right = lambda c: F.avg((yes(c) == F.col(y)).cast("double"))
    split = rows.withColumn("part", F.coalesce(part, F.lit("")))
    found = split.groupingSets([[F.col(unit)], [F.col(unit), F.col("part")]], F.col(unit), F.col("part"))
    return found.agg(F.count("*").alias("n"), F.avg(y).alias("yes_label"), F.avg(yes(raw)).alias("yes_raw"), F.avg(yes(calibrated)).alias("yes_calibrated"), right(raw).alias("accuracy_raw"), right(calibrated).alias("accuracy_calibrated"))


def _measured(rows: DataFrame, kept: list[str], k: int) -> DataFrame:
    """kept, conf, correct, nll and off (distance from y) of softmax((z + bias) / temperature), in plain columns, which compile."""
    each, most = range(k), lambda c: F.greatest(*(F.col(f"{c}{j}") for j in range(k))) if k > 1 else F.col(f"{c}0")
    total = lambda c: sum((c(j) for j in each), F.lit(0.0))
    p, y = [F.col(f"_p{j}") for j in each], F.col("y")
    v = rows.select(*kept, *(((F.get("z", F.lit(j)) + F.get("bias", F.lit(j))) / F.col("temperature")).alias(f"_v{j}") for j in each)).withColumn("_top", most("_v"))
    e = v.select(*kept, *(F.exp(F.col(f"_v{j}") - F.col("_top")).alias(f"_e{j}") for j in each)).withColumn("_sum", total(lambda j: F.col(f"_e{j}")))
    scored = e.select(*kept, *((F.col(f"_e{j}") / F.col("_sum")).alias(f"_p{j}") for j in each)).withColumn("conf", most("_p"))
    best = F.coalesce(*(F.when(p[j] == F.col("conf"), F.lit(j)) for j in each))
    own = F.coalesce(*(F.when(y == j, p[j]) for j in each))
    return scored.select(*kept, "conf", (best == y).cast("int").alias("correct"), (-F.log(F.greatest(own, F.lit(A.TINY)))).alias("nll"), F.abs(total(lambda j: p[j] * j) - y).alias("off"))


def level_offsets(rows: DataFrame, unit: str, k: int, tie: str = "item_id", draws: int = 50) -> DataFrame:
    """Raw scores, one temperature, and a bias for each level with a temperature, fitted on `calibration` and measured on `test`.

    rows: unit, split, tie, z (k numbers), y from 0. unit, fit, n, accuracy, mae, nll, ece, ece_floor, temperature, bias (of each level,
    the first is 0). A unit without calibration rows keeps its raw line only.
    """
    with newton.packed(rows.filter("split = 'calibration'").select(unit, "z", "y"), unit) as blocks:
        flat = {u: np.r_[f.w, np.zeros(k)] for u, f in newton.temperature(blocks, unit).items()}
        full = {u: np.r_[f.w[0], 0.0, f.w[1:]] for u, f in newton.vector_scaling(blocks, unit, k).items()}
    units = {r[0] for r in rows.select(unit).distinct().collect()}  # as the fits: units are few
    named = [(name, {u: p for u, p in found.items() if u in units}) for name, found in (("raw", dict.fromkeys(units, np.zeros(k + 1))), ("temperature", flat), ("level_bias", full))]
    kind = rows.schema[unit].dataType.simpleString()
    spark = rows.sparkSession
    params = spark.createDataFrame([(u, name, float(np.exp(p[0])), [float(x) for x in p[1:]]) for name, found in named for u, p in found.items()], f"`_{unit}` {kind}, fit string, temperature double, bias array<double>")
    test = rows.filter("split = 'test'").join(F.broadcast(params), F.col(unit).eqNullSafe(F.col(f"_{unit}"))).drop(f"_{unit}")  # three rows a unit
    test = cut(_measured(test, [unit, "fit", tie, "y"], k))
    keys = [unit, "fit"]
    bins = metrics.binned(test.select(*keys, tie, "conf", "correct"), keys, "conf", tie)
    error = bins.groupBy(*keys, "bin").agg(F.abs(F.avg("conf") - F.avg("correct")).alias("gap"), F.count("*").alias("m")).groupBy(*keys).agg((F.sum(F.col("m") * F.col("gap")) / F.sum("m")).alias("ece"))
    floor = ece_floor(bins, keys, "conf", tie, draws, hashed_uniform)
    found = test.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg("off").alias("mae"), F.avg("nll").alias("nll"))
    fitted = params.withColumnRenamed("fit", "_fit")
    named = F.col(unit).eqNullSafe(F.col(f"_{unit}")) & (F.col("fit") == F.col("_fit"))
    return _joined(_joined(found, error, keys), floor, keys).join(F.broadcast(fitted), named).drop(f"_{unit}", "_fit")


def defects(hits: DataFrame, defective: DataFrame, unit: list[str], item: str, system: str, systems: list[str], correct: str) -> DataFrame:
    """Accuracy with and without items whose test is at fault by a rule of their source, not by any answer.

    defective: a column named as item. unit, scope (all, without), system, n_own and accuracy_own (the items it answered), n_shared
    and accuracy_shared (the items that all answered), wrong_for_all (shared items that no system gets right).
    """
    wide = side_by_side(hits, unit, item, system, systems, [correct])
    bad = defective.select(F.col(item).alias("_bad")).distinct()
    marked = wide.join(bad, F.col(item) == F.col("_bad"), "left")
    shared, any_right = F.lit(True), F.lit(False)
    for i in range(len(systems)):
        shared = shared & F.col(f"v{i}").isNotNull()
        any_right = any_right | F.coalesce(F.col(f"v{i}")[correct].cast("boolean"), F.lit(False))
    each = F.array(*(F.struct(F.lit(s).alias("system"), F.col(f"v{i}")[correct].cast("int").alias("c")) for i, s in enumerate(systems)))
    scopes = F.when(F.col("_bad").isNull(), F.array(F.lit("all"), F.lit("without"))).otherwise(F.array(F.lit("all")))
    long = marked.select(*unit, scopes.alias("scopes"), shared.alias("shared"), (shared & ~any_right).alias("lost"), F.explode(each).alias("e")).select(*unit, F.explode("scopes").alias("scope"), "shared", "lost", "e.*").filter("c is not null")
    return long.groupBy(*unit, "scope", "system").agg(F.count("*").alias("n_own"), F.avg("c").alias("accuracy_own"), F.count_if("shared").alias("n_shared"), F.avg(F.when(F.col("shared"), F.col("c"))).alias("accuracy_shared"), F.count_if("lost").alias("wrong_for_all"))


def route_gaps(hits: DataFrame, unit: str, item: str, route: str, base: str, others: list[str], correct: str) -> DataFrame:
    """unit, route, n, accuracy, points (percent over the base) on the items that all routes answered."""
    routes = [base, *others]
    wide = side_by_side(hits, [unit], item, route, routes, [correct]).dropna(subset=[f"v{i}" for i in range(len(routes))])
    each = F.array(*(F.struct(F.lit(r).alias("route"), F.col(f"v{i}")[correct].cast("int").alias("c")) for i, r in enumerate(routes)))
    long = wide.select(unit, F.col("v0")[correct].cast("int").alias("b"), F.explode(each).alias("e")).select(unit, "b", "e.*")
    return long.groupBy(unit, "route").agg(F.count("*").alias("n"), F.avg("c").alias("accuracy"), (100 * F.avg(F.col("c") - F.col("b"))).alias("points"))


@dataclass(frozen=True)
class Claim:
    """A prediction registered before the run: every unit's (or one unit's) gap of a route lies within [low, high] points."""

    name: str
    route: str
    low: float = float("-inf")
    high: float = float("inf")
    unit: str | None = None


def verdicts(gaps: DataFrame, unit: str, claims: list[Claim]) -> DataFrame:
    """claim, units, least, greatest (points), supported; without a unit measured a claim is not supported."""
    spark = gaps.sparkSession
    asked = spark.createDataFrame([(c.name, c.route, float(c.low), float(c.high), c.unit) for c in claims], "claim string, _route string, low double, high double, _only string")
    fits = (F.col("route") == F.col("_route")) & (F.col("_only").isNull() | (F.col("_only") == F.col(unit).cast("string")))
    met = F.coalesce(F.every(F.when(F.col("points").isNotNull(), F.round("points", 9).between(F.col("low"), F.col("high")))), F.lit(False))
    return asked.join(gaps, fits, "left").groupBy("claim").agg(F.count("points").alias("units"), F.min("points").alias("least"), F.max("points").alias("greatest"), met.alias("supported"))


def route_intervals(hits: DataFrame, unit: str, item: str, route: str, correct: str, draws: int = 1000) -> DataFrame:
    """unit, route, mean, low, high: bootstrap intervals of each route's accuracy over its items."""
    name = F.concat_ws("\x1f", F.coalesce(F.col(unit).cast("string"), F.lit("\0")), F.col(route).cast("string"))
    found = cluster_bootstrap(hits.withColumn("_name", name), "_name", item, correct, draws=draws)
    parts = F.split("_name", "\x1f")
    return found.select(F.when(parts[0] != "\0", parts[0]).alias(unit), parts[1].alias("route"), "mean", "low", "high", "clusters")
