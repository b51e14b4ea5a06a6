"""From logits to probabilities, confidences and answers."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions import arrays as A
from calibra.operators import metrics
from calibra.plans._register import Registry
from calibra.sources import standins as S

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
SCALE = 10.0


def prototypes(vectors: DataFrame) -> DataFrame:
    """One row: an array with the mean calibration vector of each label, and the labels."""
    flat = vectors.filter(F.col("vec_id") % 2 == 0).select("label", F.posexplode("embedding").alias("i", "x"))
    mean = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("proto"))


def dual_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, p over the labels in order: scaled dot products with each label's prototype, on test vectors."""
    vectors = S.read(spark, sf_dir, "embeddings")
    protos = prototypes(vectors).agg(F.array_sort(F.collect_list(F.struct("label", "proto"))).alias("protos"))  # one row of labels x dimensions
    test = vectors.filter(F.col("vec_id") % 2 == 1).withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    keyed = test.withColumn("_one", F.lit(1)).join(F.broadcast(protos.withColumn("_one", F.lit(1))), "_one")
    z = F.transform("protos", lambda r: F.round(A.dot(r["proto"], F.col("e")) * SCALE, 9))
    scored = keyed.select("vec_id", "label", z.alias("z"), F.transform("protos", lambda r: r["label"]).alias("keys"))
    return scored.select("vec_id", "label", A.softmax(F.col("z")).alias("p"), "keys")


@query(f"""
WITH flat AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
protos AS (SELECT label AS k, i, avg(x) AS m FROM flat WHERE vec_id % 2 = 0 GROUP BY 1, 2),
z AS (SELECT f.vec_id, f.label, p.k, round(sum(f.x * p.m) * {SCALE}, 9) AS z FROM flat f JOIN protos p ON f.i = p.i WHERE f.vec_id % 2 = 1 GROUP BY 1, 2, 3),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e),
best AS (SELECT vec_id, label, max(p) AS conf, arg_max(k, p) AS pred FROM p GROUP BY 1, 2),
bins AS (SELECT *, ntile(15) OVER (ORDER BY round(conf, 9), vec_id) AS b FROM best)
SELECT (SELECT count(*) FROM best) AS n, (SELECT round(avg(CAST(pred = label AS INT)), 6) FROM best) AS accuracy,
  round(sum(c * abs(a - q)) / sum(c), 6) AS ece FROM (SELECT b, count(*) AS c, avg(conf) AS q, avg(CAST(pred = label AS INT)) AS a FROM bins GROUP BY b)""")
def dual_encoder_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dual_encoder(spark, sf_dir).select(F.lit(1).alias("unit"), "vec_id", F.round(A.top(F.col("p")), 9).alias("conf"), (F.get("keys", A.argmax(F.col("p"))) == F.col("label")).cast("int").alias("correct"))
    e = metrics.ece(rows, ["unit"], "conf", "correct", "vec_id")
    return rows.groupBy("unit").agg(F.count("*").alias("n"), F.round(F.avg("correct"), 6).alias("accuracy")).join(e, "unit").select("n", "accuracy", F.round("ece", 6).alias("ece"))


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.scores(spark, sf_dir).withColumn("p", A.softmax(F.col("z")))
    return p.withColumn("pred", A.argmax(F.col("p"))).withColumn("conf", A.top(F.col("p"))).withColumn("correct", (F.col("pred") == F.col("y")).cast("int"))


def _flat(df: DataFrame, array: str) -> DataFrame:
    return df.select("item_id", F.posexplode(array).alias("k", "v")).select("item_id", F.col("k").cast("long").alias("k"), F.round("v", 6).alias("v"))


_FLAT = "SELECT item_id, generate_subscripts(a, 1) - 1 AS k, round(unnest(a), 6) AS v FROM"


@query(f"WITH {S.PROBS} {_FLAT} (SELECT item_id, p AS a FROM probs)")
def softmax_probs(spark, sf_dir):
    return _flat(probs(spark, sf_dir), "p")


@query(f"WITH {S.NOULS} SELECT item_id, round(1 / (1 + exp(-z)), 6) AS p, round(2 * abs(1 / (1 + exp(-z)) - 0.5), 6) AS conf, CASE WHEN 1 / (1 + exp(-z)) >= 0.5 THEN 1 ELSE 0 END AS pred FROM nouls")
def sigmoid_probs(spark, sf_dir):
    p = A.sigmoid(F.col("z"))
    return S.nouls(spark, sf_dir).select("item_id", F.round(p, 6).alias("p"), F.round(A.yes_confidence(p), 6).alias("conf"), F.when(p >= 0.5, 1).otherwise(0).alias("pred"))


@query(f"""WITH {S.PROBS} SELECT item_id, round(1 + list_sum(list_transform(p, lambda x: x * ln(x))) / ln(5), 6) AS confidence,
  round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin, round(list_sum(list_transform(list_zip(p, [0, 1, 2, 3, 4]), lambda t: t[1] * t[2])), 6) AS expected, CAST(pred AS INT) AS pred FROM probs""")
def confidence_margin_expected(spark, sf_dir):
    p = F.col("p")
    return probs(spark, sf_dir).select("item_id", F.round(A.entropy_confidence(p), 6).alias("confidence"), F.round(A.margin(p), 6).alias("margin"), F.round(A.expected_level(p), 6).alias("expected"), "pred")


@query(f"""WITH {S.SCORES} SELECT item_id, round(y1 - y2, 6) AS logit, round(greatest(0, least(1, 1 - exp(y1 - nn) - exp(y2 - nn))), 6) AS off_mass FROM (
  SELECT item_id, ln(exp(z[1]) + exp(z[2])) AS y1, ln(exp(z[3]) + exp(z[4])) AS y2, ln(exp(z[1]) + exp(z[2]) + exp(z[3]) + exp(z[4]) + exp(z[5])) AS nn FROM scores)""")
def logsumexp_offmass(spark, sf_dir):
    z = F.col("z")
    yes, no, norm = F.slice(z, 1, 2), F.slice(z, 3, 2), A.logsumexp(z)
    return S.scores(spark, sf_dir).select("item_id", F.round(A.statement_logit(yes, no), 6).alias("logit"), F.round(A.off_mass(yes, no, norm), 6).alias("off_mass"))


@query(f"""WITH {S.SCORES}, r AS (SELECT item_id, z, unnest([0, 1, 2, 4]) AS s FROM scores),
  back AS (SELECT item_id, generate_subscripts([1, 2, 3, 4, 5], 1) - 1 AS k, unnest([z[(0 - s + 5) % 5 + 1], z[(1 - s + 5) % 5 + 1], z[(2 - s + 5) % 5 + 1], z[(3 - s + 5) % 5 + 1], z[(4 - s + 5) % 5 + 1]]) AS v FROM r)
  SELECT item_id, k, round(avg(v), 6) AS v FROM back GROUP BY item_id, k""")
def letter_rotation_mean(spark, sf_dir):
    z = F.col("z")
    turned = F.transform(A.rotations(F.size(z), 4), lambda s: A.unrotate(z, s))
    return _flat(S.scores(spark, sf_dir).withColumn("m", A.mean_of(turned)), "m")


_MEMBERS = f"WITH {S.SCORES}, {S.SCORES1}, two AS (SELECT a.item_id, a.z AS z0, b.z AS z1 FROM scores a JOIN scores1 b USING (item_id))"


def _two(spark, sf_dir):
    return S.scores(spark, sf_dir).join(S.scores(spark, sf_dir, 1).select("item_id", F.col("z").alias("z1")), "item_id")


@query(f"{_MEMBERS} {_FLAT} (SELECT item_id, [(z0[1] + z1[5]) / 2, (z0[2] + z1[4]) / 2, (z0[3] + z1[3]) / 2, (z0[4] + z1[2]) / 2, (z0[5] + z1[1]) / 2] AS a FROM two)")
def member_mean_reversed(spark, sf_dir):
    return _flat(_two(spark, sf_dir).withColumn("m", A.mean_of(F.array("z", F.reverse("z1")))), "m")


@query(f"{_MEMBERS} {_FLAT} (SELECT item_id, list_concat(z0, z1) AS a FROM two)")
def member_concat(spark, sf_dir):
    return _flat(_two(spark, sf_dir).withColumn("m", F.concat("z", "z1")), "m")


@query(f"""WITH {S.SCORES}, s AS (SELECT item_id, list_transform(z[1:4], lambda x: 1 / (1 + exp(-x))) AS s FROM scores),
  f AS (SELECT item_id, s[1] AS a, least(s[1], s[2]) AS b, least(s[1], s[2], s[3]) AS c, least(s[1], s[2], s[3], s[4]) AS d FROM s),
  p AS (SELECT item_id, list_transform([1 - a, a - b, b - c, c - d, d], lambda x: greatest(x, 1e-9)) AS p FROM f)
  {_FLAT} (SELECT item_id, list_transform(p, lambda x: x / list_sum(p)) AS a FROM p)""")
def cumulative_to_levels(spark, sf_dir):
    return _flat(S.scores(spark, sf_dir).withColumn("m", A.cumulative_to_levels(F.slice("z", 1, 4))), "m")


@query(f"WITH {S.NOULS} SELECT item_id, round(1 / (1 + exp(-(1.3::DOUBLE * z - 0.4::DOUBLE))), 6) AS p FROM nouls")
def platt_apply(spark, sf_dir):
    return S.nouls(spark, sf_dir).select("item_id", F.round(A.sigmoid(F.col("z") * 1.3 - 0.4), 6).alias("p"))


@query(f"""WITH {S.SCORES}, e AS (SELECT item_id, list_transform(z, lambda x: exp((x - list_max(z)) / 1.7::DOUBLE)) AS e FROM scores)
  {_FLAT} (SELECT item_id, list_transform(e, lambda x: x / list_sum(e)) AS a FROM e)""")
def temperature_apply(spark, sf_dir):
    return _flat(S.scores(spark, sf_dir).withColumn("m", A.softmax(F.col("z"), 1.7)), "m")


@query(f"""WITH {S.NOULS} SELECT item_id, round(CASE WHEN z <= -1.0 THEN 0.1::DOUBLE WHEN z >= 2.0 THEN 0.9::DOUBLE WHEN z < 0.5 THEN 0.1::DOUBLE + 0.3::DOUBLE * (z + 1) / 1.5::DOUBLE
  ELSE 0.4::DOUBLE + 0.5::DOUBLE * (z - 0.5::DOUBLE) / 1.5::DOUBLE END, 6) AS p FROM nouls""")
def isotonic_apply(spark, sf_dir):
    xs, ys = (F.array(*map(F.lit, v)) for v in ([-1.0, 0.5, 2.0], [0.1, 0.4, 0.9]))
    return S.nouls(spark, sf_dir).select("item_id", F.round(A.interpolate(F.col("z"), xs, ys), 6).alias("p"))


@query(f"""WITH {S.SCORES}, x AS (SELECT item_id, list_transform(z, lambda v: (v - 0.5::DOUBLE) / (2 + 1e-6)) AS x FROM scores),
  l AS (SELECT item_id, [x[1] + 0.5::DOUBLE * x[2], x[3] + 0.1::DOUBLE, x[5] - x[1] - 0.1::DOUBLE] AS l FROM x), e AS (SELECT item_id, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM l)
  {_FLAT} (SELECT item_id, list_transform(e, lambda v: v / list_sum(e)) AS a FROM e)""")
def matrix_apply(spark, sf_dir):
    const = lambda v: F.array(*map(F.lit, v))
    w = F.array(const([1.0, 0.5, 0.0, 0.0, 0.0]), const([0.0, 0.0, 1.0, 0.0, 0.0]), const([-1.0, 0.0, 0.0, 0.0, 1.0]))
    return _flat(S.scores(spark, sf_dir).withColumn("m", A.matrix_apply(F.col("z"), w, const([0.0, 0.1, -0.1]), const([0.5] * 5), const([2.0] * 5))), "m")


@query(f"""WITH {S.SCORES}, f AS (SELECT item_id, grp, generate_subscripts(z, 1) - 1 AS k, unnest(z) AS v FROM scores),
  s AS (SELECT grp, k, avg(v) AS m, stddev_pop(v) AS d FROM f GROUP BY 1, 2) SELECT f.item_id, f.k, round((f.v - s.m) / (s.d + 1e-6), 6) AS v FROM f JOIN s ON f.grp = s.grp AND f.k = s.k""")
def unlabeled_zscore_fit(spark, sf_dir):
    from calibra.operators.fits import standardize

    return _flat(standardize(S.scores(spark, sf_dir), ["grp"], "z"), "x")


@query(f"""WITH {S.SCORES}, f AS (SELECT item_id, split, generate_subscripts(z, 1) - 1 AS k, unnest(z) AS v FROM scores), m AS (SELECT k, avg(v) AS m FROM f WHERE item_id % 50 = 0 GROUP BY k)
  SELECT f.item_id, f.k, round(f.v - m.m, 6) AS v FROM f JOIN m ON f.k = m.k""")
def null_prior_subtract(spark, sf_dir):
    rows = S.scores(spark, sf_dir)
    prior = rows.filter(F.col("item_id") % 50 == 0).select(F.posexplode("z").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    one = prior.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("prior")).withColumn("_one", F.lit(1))
    return _flat(rows.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").withColumn("m", F.zip_with("z", "prior", lambda a, b: a - b)), "m")


@query(f"""{_MEMBERS}, e AS (SELECT item_id, list_transform(z0, lambda x: exp(x - list_max(z0))) AS e0, list_transform(list_zip(z0, z1), lambda t: (t[1] + t[2]) / 2) AS zz FROM two),
  g AS (SELECT item_id, list_transform(e0, lambda x: x / list_sum(e0)) AS p0, list_transform(zz, lambda x: exp(x - list_max(zz))) AS e1 FROM e),
  h AS (SELECT item_id, p0, list_transform(e1, lambda x: x / list_sum(e1)) AS p1, unnest([0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]) AS tau FROM g)
  SELECT tau, count(*) AS n, CAST(sum(CASE WHEN list_max(p0) < tau THEN 1 ELSE 0 END) AS BIGINT) AS escalated, round(avg(CASE WHEN list_max(p0) < tau THEN list_max(p1) ELSE list_max(p0) END), 6) AS mean_conf FROM h GROUP BY tau""")
def adaptive_escalation(spark, sf_dir):
    rows = _two(spark, sf_dir).select(A.softmax(F.col("z")).alias("fast"), A.softmax(A.mean_of(F.array("z", "z1"))).alias("full"), F.explode(F.array(*map(F.lit, (0.4, 0.6, 0.8)))).alias("tau"))
    low = A.top(F.col("fast")) < F.col("tau")
    return rows.groupBy("tau").agg(F.count("*").alias("n"), F.count_if(low).alias("escalated"), F.round(F.avg(F.when(low, A.top(F.col("full"))).otherwise(A.top(F.col("fast")))), 6).alias("mean_conf"))


@query(f"WITH {S.PROBS} SELECT item_id, ['very bad', 'bad', 'fair', 'good', 'very good'][pred + 1] AS answer, round(p[pred + 1], 6) AS probability FROM probs")
def answer_assembly(spark, sf_dir):
    keys = F.array(*map(F.lit, ("very bad", "bad", "fair", "good", "very good")))
    found = probs(spark, sf_dir).withColumn("answers", F.map_from_arrays(keys, F.transform("p", lambda x: F.round(x, 6)))).withColumn("answer", F.get(keys, F.col("pred")))
    return found.select("item_id", "answer", F.col("answers")[F.col("answer")].alias("probability"))


@query("SELECT p_partkey AS item_id, p_size * 40 AS w, (p_size * 40) // 3 AS x0, (p_size * 40) // 3 + (p_size * 40) // 3 AS x1 FROM part")
def zoom_box(spark, sf_dir):
    w = F.col("p_size") * 40
    return S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), w.alias("w"), F.expr("(p_size * 40) div 3").cast("int").alias("x0"), F.expr("(p_size * 40) div 3 + (p_size * 40) div 3").cast("int").alias("x1"))


@query(f"WITH {S.CALLS} SELECT user_id, max(tokens) AS image_tokens, CAST(count(*) AS BIGINT) AS passes, round(sum(CASE WHEN event_type = 'purchase' THEN latency_ms END), 4) AS cost FROM calls GROUP BY user_id")
def usage_accumulator(spark, sf_dir):
    return S.calls(spark, sf_dir).groupBy("user_id").agg(F.max("tokens").alias("image_tokens"), F.count("*").alias("passes"), F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("latency_ms"))), 4).alias("cost"))
