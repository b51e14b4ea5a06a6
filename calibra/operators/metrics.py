"""Evaluation metrics. Nothing is gathered or sorted by unit: ranks come from ranges of the order (`ranks.running`)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions import arrays as A
from calibra.operators.ranks import running
from calibra.sources.scratch import FEW_ROWS, cut

BINS = 15
#: Ranges of confidence that are counted before any row is ranked: it sets the work, not the result.
RANGES = 4096
COVERAGES = (50, 80, 90, 100)


def binned(df: DataFrame, unit: list[str], conf: str, tie: str, bins: int = BINS) -> DataFrame:
    """df with an equal-mass bin from 0: sorted by confidence and dealt into min(bins, n) runs, the longer ones first.

    Ranges of confidence are counted first: rows of a range that lies in one bin take it, and only those of the ranges that a
    border of bins cuts are ranked. df is read three times.
    """
    rows = df.withColumn("_range", _range(F.col(conf).cast("double")))
    placed = placed_ranges(cut(rows.groupBy(*unit, "_range").agg(F.count("*").alias("n"))), unit, bins)
    whole = _at_ranges(rows, placed.filter("bin = last").select(*unit, "_range", "bin"), unit).select(*df.columns, "bin")
    cut_through = _at_ranges(rows, placed.filter("bin <> last").select(*unit, "_range", "before", "all"), unit)
    ranked = running(cut_through, [*unit, "_range"], conf, tie).withColumn("bin", bin_at(F.col("before") + F.col("_rank") - 1, F.col("all"), bins))
    return whole.unionByName(ranked.select(*df.columns, "bin"))


def _range(value: Column) -> Column:
    """The range of a confidence, rising with it; -1 for null."""
    return F.when(value.isNull(), -1).otherwise(F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * RANGES).cast("int"))


def placed_ranges(per: DataFrame, unit: list[str], bins: int = BINS) -> DataFrame:
    """per (a row for each range of a unit, with its n rows) with the rows before it, all rows of the unit, and its first and last bin."""
    whole = Window.partitionBy(*unit)  # at most a row for each range
    before = F.coalesce(F.sum("n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut(per.withColumns({"before": before, "all": F.sum("n").over(whole)}).withColumns({"bin": bin_at(F.col("before"), F.col("all"), bins), "last": bin_at(F.col("before") + F.col("n") - 1, F.col("all"), bins)}))


def _at_ranges(rows: DataFrame, places: DataFrame, unit: list[str]) -> DataFrame:
    """The rows whose unit and range places has, with its other columns."""
    few = places.count() <= FEW_ROWS
    places = places.withColumnsRenamed({"_range": "_br"} | {u: f"_b{i}" for i, u in enumerate(unit)})
    same = F.col("_range").eqNullSafe(F.col("_br"))  # plain equality would push a test for null, with all that _range is made of, below the projections
    for i, u in enumerate(unit):
        same &= F.col(u).eqNullSafe(F.col(f"_b{i}"))
    return rows.join(F.broadcast(places) if few else places, same).drop("_br", *(f"_b{i}" for i in range(len(unit))))


def bin_at(r: Column, n: Column, bins: int = BINS) -> Column:
    """The bin of place r, from 0, of n rows."""
    b = F.least(F.lit(bins), n)
    size, extra = F.floor(n / b), n % b
    return F.when(r < extra * (size + 1), F.floor(r / (size + 1))).otherwise(extra + F.floor((r - extra * (size + 1)) / size)).cast("int")


def reliability(df: DataFrame, unit: list[str], conf: str, correct: str, tie: str) -> DataFrame:
    """confidence, accuracy and n of each bin."""
    return binned(df.select(*unit, conf, correct, tie), unit, conf, tie).groupBy(*unit, "bin").agg(F.avg(conf).alias("confidence"), F.avg(correct).alias("accuracy"), F.count("*").alias("n"))


def ece(df: DataFrame, unit: list[str], conf: str, correct: str, tie: str) -> DataFrame:
    """unit, ece over equal-mass bins, as of `reliability`.

    Ranges of confidence are summed first; a range that lies in one bin counts as a whole, and only rows of the ranges
    that a border of bins cuts are ranked. df is read twice.
    """
    value = F.col(conf).cast("double")
    rows = df.select(*unit, value.alias("_c"), F.col(correct).cast("double").alias("_h"), F.col(tie).alias("_tie"), _range(value).alias("_range"))
    sums = [F.sum("_c").alias("c"), F.count("_c").alias("cn"), F.sum("_h").alias("h"), F.count("_h").alias("hn"), F.count("*").alias("n")]
    placed = placed_ranges(cut(rows.groupBy(*unit, "_range").agg(*sums)), unit)
    parts = placed.filter("bin = last").select(*unit, "bin", "c", "cn", "h", "hn", "n")
    borders = placed.filter("bin <> last").select(*unit, "_range", "before", "all")
    if not borders.isEmpty():
        cut_through = _at_ranges(rows, borders, unit).select(*unit, "_range", "_c", "_h", "_tie", "before", "all")
        ranked = running(cut_through, [*unit, "_range"], "_c", "_tie").withColumn("bin", bin_at(F.col("before") + F.col("_rank") - 1, F.col("all")))
        parts = parts.unionByName(ranked.groupBy(*unit, "bin").agg(*sums))
    bins = parts.groupBy(*unit, "bin").agg(*(F.sum(c).alias(c) for c in ("c", "cn", "h", "hn", "n")))
    gap = F.abs(F.try_divide(F.col("c"), F.col("cn")) - F.try_divide(F.col("h"), F.col("hn")))
    return bins.groupBy(*unit).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def selective(df: DataFrame, unit: list[str], conf: str, correct: str, tie: str) -> DataFrame:
    """Accuracy of the most confident share of a unit, at least one row; shares round half to even."""
    kept = lambda c: F.col("_rank") <= F.greatest(F.lit(1), F.bround(F.lit(c / 100) * F.col("_n")))
    return running(df.select(*unit, conf, correct, tie), unit, conf, tie, desc=True).groupBy(*unit).agg(*(F.avg(F.when(kept(c), F.col(correct).cast("double"))).alias(f"acc_at_{c}") for c in COVERAGES))


def risk_coverage(df: DataFrame, unit: list[str], conf: str, correct: str, tie: str) -> DataFrame:
    ranked = running(df.select(*unit, conf, correct, tie), unit, conf, tie, {"wrong": 1 - F.col(correct).cast("long")}, desc=True)
    return ranked.select(*unit, tie, F.col("_rank").alias("k"), (F.col("_wrong") / F.col("_rank")).alias("risk"))


def average_ranks(df: DataFrame, unit: list[str], by: str, out: str) -> DataFrame:
    """unit, by and the average rank of each value of by, from counts per value."""
    counts = df.groupBy(*unit, by).agg(F.count("*").alias("_k"))
    return running(counts, unit, by, by, {"upto": F.col("_k")}).select(*unit, by, (F.col("_upto") - (F.col("_k") - 1) / F.lit(2.0)).alias(out))


def auroc(df: DataFrame, unit: list[str], score: str, y: str) -> DataFrame:
    """Rank statistic with ties; null for one class. Counts per distinct score come first, so ties are one row each."""
    n = df.groupBy(*unit, score).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("q"))
    won = running(n, unit, score, score, {"q_upto": F.col("q")}).withColumn("_w", F.col("p") * (F.col("_q_upto") - F.col("q") / F.lit(2.0)))
    return won.groupBy(*unit).agg(F.try_divide(F.sum("_w"), F.sum("p") * F.sum("q")).alias("auroc"))


def macro_f1(df: DataFrame, unit: list[str], pred: str, y: str) -> DataFrame:
    """Unweighted over labels that occur as truth or prediction; an undefined F1 is 0."""
    cells = df.groupBy(*unit, F.col(y).alias("_y"), F.col(pred).alias("_p")).agg(F.count("*").alias("_n"))
    sides = cells.select(*unit, F.explode(F.array(F.struct(F.col("_y").alias("label"), F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0).alias("tp"), F.col("_n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("_p").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.col("_n").alias("p")))).alias("s"))
    f1 = sides.groupBy(*unit, "s.label").agg((2.0 * F.sum("s.tp") / (F.sum("s.t") + F.sum("s.p"))).alias("f1"))
    return f1.groupBy(*unit).agg(F.avg("f1").alias("macro_f1"))


def correlations(df: DataFrame, unit: list[str], x: str, y: str) -> DataFrame:
    counts = df.groupBy(*unit, x, y).agg(F.count("*").alias("_c"))  # equal pairs once
    ranked = counts.join(average_ranks(df, unit, x, "_rx"), [*unit, x]).join(average_ranks(df, unit, y, "_ry"), [*unit, y])

    def corr(a: str, b: str):
        c, p, q = F.col("_c"), F.col(a).cast("double"), F.col(b).cast("double")
        n = F.sum(c)
        cov = F.sum(c * p * q) / n - F.sum(c * p) / n * F.sum(c * q) / n
        spread = lambda v: F.sqrt(F.sum(c * v * v) / n - F.pow(F.sum(c * v) / n, F.lit(2.0)))
        return F.try_divide(cov, spread(p) * spread(q))

    return ranked.groupBy(*unit).agg(corr(x, y).alias("pearson"), corr("_rx", "_ry").alias("spearman"))


def confusion(df: DataFrame, unit: list[str], pred: str, y: str, k: int) -> DataFrame:
    """One row for each truth, one column for each prediction."""
    return df.groupBy(*unit, y).agg(*(F.count_if(F.col(pred) == j).alias(f"pred_{j}") for j in range(k)))


def top_confusions(df: DataFrame, unit: list[str], pred: str, y: str, tie: str, k: int = 3) -> DataFrame:
    wrong = df.filter(F.col(pred) != F.col(y)).groupBy(*unit, y, pred).agg(F.count("*").alias("n"), F.min(tie).alias("first_seen"))
    w = Window.partitionBy(*unit).orderBy(F.desc("n"), "first_seen")
    return wrong.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def confident_errors(df: DataFrame, unit: list[str], conf: str, correct: str, tie: str, k: int = 20) -> DataFrame:
    w = Window.partitionBy(*unit).orderBy(F.desc(conf), tie)
    return df.filter(F.col(correct) == 0).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bundle(df: DataFrame, unit: list[str], p: str, y: str) -> DataFrame:
    """n, accuracy, nll, brier, mae and within-one of probability rows."""
    pc, yc = F.col(p), F.col(y)
    pred = A.argmax(pc)
    return df.groupBy(*unit).agg(
        F.count("*").alias("n"), F.avg((pred == yc).cast("double")).alias("accuracy"), F.avg(A.nll(pc, yc)).alias("nll"), F.avg(A.brier(pc, yc)).alias("brier"),
        F.avg(F.abs(A.expected_level(pc) - yc)).alias("mae"), F.avg((F.abs(pred - yc) <= 1).cast("double")).alias("within_one"),
    )


GATES = {"gap": 0.05, "ece": 0.05, "failures": 0.02, "latency_ms": 500.0}


def go_no_go(measured: DataFrame) -> DataFrame:
    """measured: gap, ece, failures, latency_ms (null: not measured). Any failed gate is NO-GO; all passed is GO."""
    passed = [F.col(c) <= limit for c, limit in GATES.items()]
    failed = [F.coalesce(~x, F.lit(False)) for x in passed]
    any_failed, all_passed = failed[0], F.coalesce(passed[0], F.lit(False))
    for f, x in zip(failed[1:], passed[1:], strict=True):
        any_failed, all_passed = any_failed | f, all_passed & F.coalesce(x, F.lit(False))
    return measured.withColumn("verdict", F.when(any_failed, "NO-GO").when(all_passed, "GO").otherwise("PARTIAL"))
