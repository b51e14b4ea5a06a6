"""Interaction audit of document filters: who removes what in every order, by counts of failure patterns.

Words are exploded and aggregated by (document, word), then by document for totals and distinct words; the other flags
join from outside; a text's copies are settled by counts per text. What is left is one row for each part with a count
for each of the 32 patterns of failures (and for those of good and of toxic documents). Every order and step is
arithmetic on these columns.

Nulls: a null text is the empty text, a null source the part ''. A null doc_id has no smaller ids, is no smaller id, has
no labels. Rows repeated with id, source and text count each; they are not duplicates of each other (E asks for a smaller
id). Labels given several times hold if any row says so. Empty tables give no row; columns beyond those named are ignored.
"""
from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.llm._common import table

#: Failure conditions: under MIN_WORDS words; 100 * distinct < MIN_DISTINCT * words; 100 * capitals > MAX_CAPITALS * code points.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
SYMBOLS = "[#$%&*|]"
FILTERS = "ABCDE"


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, k, words, distinct_words of each (doc_id, k) with a word, of rows (doc_id, k, text); repeated rows add up.

    Whole texts are dealt by document, as fewer and better compressed rows than their words; both aggregations then need no
    shuffle of their own.
    """
    exploded = docs.repartition("doc_id", "k").select("doc_id", "k", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")
    by_word = exploded.groupBy("doc_id", "k", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("doc_id", "k").agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"))


def _bit(name: str, fails: Column) -> Column:
    return F.when(fails, F.lit(1 << FILTERS.index(name))).otherwise(F.lit(0))


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, pattern, good, toxic, n: how many documents fail just the filters whose bits pattern has (A is bit 0)."""
    docs = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    # k tells rows apart that share an id
    docs = docs.withColumn("k", F.xxhash64("part", "text"))
    others = _bit("C", 100 * F.regexp_count("text", F.lit("[A-Z]")) > MAX_CAPITALS * F.length("text")) + _bit("D", F.col("text").rlike(SYMBOLS))
    rows = docs.select("doc_id", "k", "part", F.unhex(F.sha2("text", 256)).alias("digest"), others.alias("others")).groupBy("doc_id", "k", "part", "digest", "others").agg(F.count("*").alias("m"))
    counted = word_counts(docs).toDF("w_id", "w_k", "words", "distinct_words")
    # a document without words is in no row of the counts
    rows = rows.join(counted, (F.col("k") == F.col("w_k")) & F.col("doc_id").eqNullSafe(F.col("w_id")), "left")
    words = F.coalesce(F.col("words") / F.col("m"), F.lit(0)).cast("long")
    rows = rows.select("doc_id", "part", "digest", "m", (F.col("others") + _bit("A", words < MIN_WORDS) + _bit("B", 100 * F.coalesce("distinct_words", F.lit(0)) < MIN_DISTINCT * words)).alias("pattern"))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    named = rows.filter("doc_id is not null").join(marks, "doc_id", "left").unionByName(rows.filter("doc_id is null"), allowMissingColumns=True).na.fill(False, ["good", "toxic"])
    # copies of a text melt into a row for each part and label before they meet: only the smallest id of a text passes E
    groups = named.groupBy("digest", "part", "pattern", "good", "toxic").agg(
        F.sum("m").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("m")).otherwise(0)).alias("nameless"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "m"))).alias("first"),
    )
    lowest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("nameless") + F.when(F.col("first.doc_id") == lowest, F.col("first.m")).otherwise(0)
    split = groups.withColumn("passing", passing).select("part", "good", "toxic", F.explode(F.array(F.struct("pattern", F.col("passing").alias("n")), F.struct((F.col("pattern") + _bit("E", F.lit(True))).alias("pattern"), (F.col("n") - F.col("passing")).alias("n")))).alias("s"))
    return split.select("part", "s.pattern", "good", "toxic", "s.n")


def conditional_counts(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part and three arrays of 2 ** filters counts: of all documents of a pattern, of the good and of the toxic ones."""
    size = 1 << len(filters)
    kinds = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    sums = [F.sum(F.when((F.col("pattern") == p) & which, F.col("n")).otherwise(0)).alias(f"{kind}_{p}") for kind, which in kinds.items() for p in range(size)]
    return found.groupBy("part").agg(*sums).select("part", *[F.array(*[f"{kind}_{p}" for p in range(size)]).alias(kind) for kind in kinds])


def attribution(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order and step of the filters: what is kept and removed, and the filter's share summed over all orders."""
    orders = F.explode(F.array(*[F.lit("".join(o)) for o in itertools.permutations(filters)])).alias("filter_order")
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step")
    rows = counts.select("*", orders).select("*", steps)
    bits = {f: 1 << i for i, f in enumerate(filters)}
    rows = rows.withColumn("earlier", sum(F.when(F.instr("filter_order", f) < F.col("step"), F.lit(b)).otherwise(0) for f, b in bits.items()))
    rows = rows.withColumn("own", sum(F.when(F.instr("filter_order", f) == F.col("step"), F.lit(b)).otherwise(0) for f, b in bits.items()))

    def total(kind: str, chosen, weight=lambda p: F.lit(1)) -> Column:
        picked = F.filter(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1)), chosen)
        return F.aggregate(picked, F.lit(0).cast("long"), lambda a, p: a + F.get(F.col(kind), p) * weight(p))

    fails, before = (lambda p: p.bitwiseAND(F.col("own")) != 0), (lambda p: p.bitwiseAND(F.col("earlier")) != 0)
    here = lambda p: fails(p) & ~before(p)
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), total("all", lambda p: ~fails(p) & ~before(p)).alias("kept"), total("all", here).alias("removed"),
        total("all", lambda p: fails(p) & before(p)).alias("redundant"), total("all", lambda p: p == F.col("own")).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        # of the filters that a document fails each comes first in the same number of orders
        total("all", fails, lambda p: (F.lit(math.factorial(len(filters))) / F.bit_count(p)).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return attribution(conditional_counts(patterns(docs, labels)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {
    "op13_filter_audit": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, count(*) AS words, count(DISTINCT word) AS distinct_words
  FROM (SELECT r, unnest(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+')) AS word FROM d) WHERE word <> '' GROUP BY r),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN coalesce(words, 0) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * coalesce(distinct_words, 0) < 50 * coalesce(words, 0) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS p
  FROM d LEFT JOIN w USING (r) LEFT JOIN l ON l.doc_id = d.doc_id),
letters(i, f) AS (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')),
orders AS (
  SELECT a.f || b.f || c.f || e.f || g.f AS filter_order FROM letters a, letters b, letters c, letters e, letters g
  WHERE len(list_distinct([a.f, b.f, c.f, e.f, g.f])) = 5),
steps AS (
  SELECT filter_order, step, list_sum(list_transform(range(1, step), lambda s: CAST(1 << (instr('ABCDE', substr(filter_order, s, 1)) - 1) AS INTEGER))) AS earlier,
    CAST(1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1) AS INTEGER) AS own
  FROM orders, range(1, 6) t(step)),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(earlier, 0) AS INTEGER) AS earlier, own FROM steps),
c AS (SELECT part, p, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, p)
SELECT part, filter_order, step,
  CAST(coalesce(sum(n) FILTER (WHERE (p & (own | earlier)) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (WHERE (p & own) <> 0 AND (p & earlier) = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE (p & own) <> 0 AND (p & earlier) <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE p = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE (p & own) <> 0 AND (p & earlier) = 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (WHERE (p & own) <> 0 AND (p & earlier) = 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(bit_count(p), 1))) FILTER (WHERE (p & own) <> 0), 0) AS BIGINT) AS shapley
FROM c, s GROUP BY part, filter_order, step
"""
}
