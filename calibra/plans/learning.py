"""Calibration fits and what they are used for."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions import arrays as A
from calibra.operators import fits, isotonic, metrics, newton, pixels, readout, variants
from calibra.plans._register import Registry
from calibra.sources import standins as S
from calibra.sources.scratch import cut

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
GRID = [round(-1.0 + 0.1 * i, 1) for i in range(31)]


def _params(df, key: str):
    return df.select(key, F.posexplode("params").alias("i", "value")).select(key, "i", F.round("value", 3).alias("value"))


@query(f"""WITH {S.SCORES}, g AS (SELECT grp, y, z, unnest([{", ".join(f"{g}::DOUBLE" for g in GRID)}]) AS g FROM scores WHERE split = 'calibration'),
  l AS (SELECT grp, g, round(avg(ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / exp(g))))) + (list_max(z) - z[y + 1]) / exp(g)), 9) AS nll FROM g GROUP BY 1, 2)
  SELECT grp, round(arg_min(g, nll), 6) AS log_t, round(min(nll), 6) AS nll FROM l GROUP BY grp""")
def fit_temperature_grid(spark, sf_dir):
    rows = S.scores(spark, sf_dir).filter("split = 'calibration'")
    return fits.grid_temperature(rows, "grp", "z", "y", GRID).select("grp", F.round("log_t", 6).alias("log_t"), F.round("nll", 6).alias("nll"))


@query()
def fit_temperature(spark, sf_dir):
    f = fits.fit_temperature(S.scores(spark, sf_dir).filter("split = 'calibration'"), "grp", "z", "y")
    return f.select("grp", F.round("temperature", 3).alias("temperature"), F.round("nll", 6).alias("nll"))


@query()
def fit_platt(spark, sf_dir):
    f = fits.fit_logistic(S.nouls(spark, sf_dir).filter("split = 'calibration'"), "grp", ["z"], "y")
    return f.select("grp", F.round(F.col("w")[0], 5).alias("a"), F.round(F.col("w")[1], 5).alias("b"), "n")


@query()
def fit_asymmetric_platt(spark, sf_dir):
    rows = S.nouls(spark, sf_dir).filter("split = 'calibration'").withColumn("up", F.greatest("z", F.lit(0.0))).withColumn("down", F.least("z", F.lit(0.0)))
    f = fits.fit_logistic(rows, "grp", ["up", "down"], "y")
    return f.select("grp", *(F.round(F.col("w")[i], 5).alias(c) for i, c in enumerate(("up", "down", "b"))))


@query()
def fit_threshold_platt(spark, sf_dir):
    rows = S.scores(spark, sf_dir).filter("split = 'calibration'").select("grp", "y", F.posexplode(F.slice("z", 2, 4)).alias("k", "zk"))
    rows = rows.select(F.concat_ws("/", "grp", (F.col("k") + 1).cast("string")).alias("unit"), "zk", (F.col("y") > F.col("k")).cast("int").alias("above"))
    return fits.fit_logistic(rows, "unit", ["zk"], "above").select("unit", F.round(F.col("w")[0], 5).alias("a"), F.round(F.col("w")[1], 5).alias("b"))


@query()
def fit_isotonic(spark, sf_dir):
    """The monotone map of all yes/no decisions."""
    rows = S.nouls(spark, sf_dir).filter("split = 'calibration'").withColumn("unit", F.lit("all"))
    ends = isotonic.fit(rows, "unit", "z", "y", 1).select(F.posexplode(F.arrays_zip("xs", "ys")).alias("i", "e"))
    return ends.select("i", F.round("e.xs", 6).alias("boundary"), F.round("e.ys", 6).alias("prediction"))


@query(f"""WITH {S.SCORES}, r AS (SELECT unnest([grp, 'POOLED']) AS unit, round(z[4], 1) AS x, CAST(y >= 3 AS INT) AS yes FROM scores WHERE split = 'calibration'),
  v AS (SELECT unit, x, sum(yes) AS s, count(*) AS n FROM r GROUP BY ALL), big AS (SELECT unit FROM v GROUP BY unit HAVING sum(n) >= {isotonic.MIN_ROWS}),
  c AS (SELECT unit, x, row_number() OVER w AS i, s, n, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM v JOIN big USING (unit) WINDOW w AS (PARTITION BY unit ORDER BY x)),
  m AS (SELECT a.unit, a.i AS a, b.i AS b, (b.cs - a.cs + a.s)::DOUBLE / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.unit = b.unit AND a.i <= b.i),
  k AS (SELECT unit, a, b, min(mean) OVER (PARTITION BY unit, a ORDER BY b DESC) AS least FROM m)
  SELECT c.unit, round(c.x, 1) AS x, round(max(k.least), 6) AS p FROM c JOIN k ON k.unit = c.unit AND k.b = c.i GROUP BY c.unit, c.x""")
def isotonic_by_suite(spark, sf_dir):
    """The monotone map of each scale with rows enough, and of all, at every score of its rows; SQL by the min-max formula."""
    rows = _calibration(spark, sf_dir).select(F.explode(F.array("grp", F.lit("POOLED"))).alias("unit"), F.round(F.get("z", F.lit(3)), 1).alias("x"), (F.col("y") >= 3).cast("int").alias("yes"))
    models = isotonic.fit(rows, "unit", "x", "yes")
    at = rows.select("unit", "x").distinct().join(models, "unit")
    return at.select("unit", "x", F.round(A.interpolate(F.col("x"), F.col("xs"), F.col("ys")), 6).alias("p"))


def _calibration(spark, sf_dir, s: int = 0):
    return S.scores(spark, sf_dir, s).filter("split = 'calibration'")


def _fitted(rows, key: str, fit) -> DataFrame:
    """fit(rows) with the rows kept for its rounds (lost ones are made again), as a table of parameters."""
    rows = rows.persist()
    found = {u: f.w for u, f in fit(rows).items()}
    rows.unpersist()
    return newton.params_table(rows.sparkSession, key, rows.schema[key].dataType.simpleString(), found)


@query()
def fit_vector_scaling(spark, sf_dir):
    return _params(_fitted(_calibration(spark, sf_dir).select("grp", "z", "y"), "grp", lambda r: newton.vector_scaling(r, "grp", S.LEVELS)), "grp")


@query()
def fit_mix_two(spark, sf_dir):
    both = _calibration(spark, sf_dir).join(S.scores(spark, sf_dir, 1).select("item_id", F.col("z").alias("z1")), "item_id")
    return _params(_fitted(both.select("grp", "z", "z1", "y"), "grp", lambda r: newton.mix_two(r, "grp")), "grp")


@query()
def fit_ordinal(spark, sf_dir):
    """Log slope, first cut and log gaps of the cumulative link on the expected level."""
    rows = _calibration(spark, sf_dir).select("grp", A.expected_level(A.softmax(F.col("z"))).alias("s"), "y")
    flat = F.concat(F.array(F.log(F.get("params", F.lit(0))), F.get("params", F.lit(1))), F.transform(F.sequence(F.lit(2), F.size("params") - 1), lambda i: F.log(F.get("params", i) - F.get("params", i - 1))))
    return _params(_fitted(rows, "grp", lambda r: newton.ordinal(r, "grp", S.LEVELS)).withColumn("params", flat), "grp")


def _matrix_rows(spark, found: dict) -> DataFrame:
    rows = [(u, i, [round(float(v), 4) for v in m.w[i]], round(float(m.b[i]), 4), round(m.sharpness, 4)) for u, m in found.items() for i in range(len(m.b))]
    return spark.createDataFrame(rows, "grp string, level int, weights array<double>, bias double, sharpness double")


@query()
def fit_matrix_cv(spark, sf_dir):
    """Matrix scaling of each scale, sharpness from held-out folds."""
    rows = _calibration(spark, sf_dir).select("grp", "item_id", "z", "y").persist()
    found = newton.matrix_scaling(rows, "grp", S.LEVELS, rescale="cv", tie="item_id")
    rows.unpersist()
    return _matrix_rows(spark, found)


@query()
def fit_matrix_prior(spark, sf_dir):
    """Matrix scaling of two concatenated readouts that shrinks towards their mean."""
    both = _calibration(spark, sf_dir).join(S.scores(spark, sf_dir, 1).select("item_id", F.col("z").alias("z1")), "item_id")
    rows = both.select("grp", "item_id", F.concat("z", "z1").alias("z"), "y").persist()
    found = newton.matrix_scaling(rows, "grp", S.LEVELS, rescale="cv", tie="item_id", prior=True)
    rows.unpersist()
    return _matrix_rows(spark, found)


def _moments(df, fit: str, p, features: dict):
    """fit, grp, moment, value: means of p times each feature; a maximum of the likelihood has the data's own there."""
    made = df.groupBy("grp").agg(*(F.avg(p * x).alias(name) for name, x in features.items()))
    pairs = F.inline(F.array(*(F.struct(F.lit(n).alias("moment"), F.round(F.col(n), 5).alias("value")) for n in features)))
    return made.select(F.lit(fit).alias("fit"), "grp", pairs)


def _levels(df, fit: str, p, with_z: bool):
    """Moments of a distribution over levels: the mean of each probability and, with a temperature, of the expected z."""
    values = {f"level_{k}": F.get(p, F.lit(k)) for k in range(S.LEVELS)} | ({"z": A.dot(p, F.col("z"))} if with_z else {})
    return _moments(df, fit, F.lit(1.0), values)


@query(f"""WITH {S.SCORES}, {S.NOULS}, s AS (SELECT * FROM scores WHERE split = 'calibration'),
  n AS (SELECT 'all' AS grp, y, z FROM nouls WHERE split = 'calibration'),
  k AS (SELECT unnest([0, 1, 2, 3, 4]) AS k)
  SELECT f AS fit, grp, 'level_' || k AS moment, round(avg(CAST(y = k AS INT)), 5) AS value FROM s, k, (SELECT unnest(['vector', 'matrix']) AS f) GROUP BY ALL
  UNION ALL SELECT 'vector', grp, 'z', round(avg(z[y + 1]), 5) FROM s GROUP BY grp
  UNION ALL SELECT 'threshold', grp || '/' || k, 'one', round(avg(CAST(y >= k AS INT)), 5) FROM s, k WHERE k > 0 GROUP BY grp, k
  UNION ALL SELECT 'threshold', grp || '/' || k, 'z', round(avg(CAST(y >= k AS INT) * z[k + 1]), 5) FROM s, k WHERE k > 0 GROUP BY grp, k
  UNION ALL SELECT 'platt', grp, 'one', round(avg(y), 5) FROM n GROUP BY grp UNION ALL SELECT 'platt', grp, 'z', round(avg(y * z), 5) FROM n GROUP BY grp""")
def score_equations(spark, sf_dir):
    """What fitted probabilities give for the moments of the data: at a maximum of the likelihood they are equal."""
    k = S.LEVELS
    rows = _calibration(spark, sf_dir).select("grp", "item_id", "z", "y").persist()
    bias = lambda p: F.concat(F.array(F.lit(0.0)), F.slice(p, 2, k - 1))
    v = newton.params_table(spark, "grp", "string", {u: f.w for u, f in newton.vector_scaling(rows, "grp", k).items()})
    vector = rows.join(F.broadcast(v), "grp").withColumn("p", A.softmax(F.zip_with("z", bias("params"), lambda a, b: a + b), F.exp(F.get("params", F.lit(0)))))
    fitted = {u: np.r_[m.w.ravel(), m.b, m.mean, m.std] for u, m in newton.matrix_scaling(rows, "grp", k, rescale="none").items()}
    matrix = rows.join(F.broadcast(newton.params_table(spark, "grp", "string", fitted)), "grp").withColumn("p", fits.matrix_probabilities(F.col("z"), F.col("params"), k))
    cumulative = rows.select("grp", "y", F.slice("z", 2, k - 1).alias("z"))
    t = newton.params_table(spark, "grp", "string", {u: p.ravel() for u, p in newton.threshold_platt(cumulative, "grp", k).items()})
    each = cumulative.join(F.broadcast(t), "grp").select("grp", "params", F.posexplode("z").alias("j", "c"))
    each = each.select(F.concat_ws("/", "grp", (F.col("j") + 1).cast("string")).alias("grp"), "c", A.sigmoid(F.get("params", 2 * F.col("j")) * F.col("c") + F.get("params", 2 * F.col("j") + 1)).alias("p"))
    asked = S.nouls(spark, sf_dir).filter("split = 'calibration'").withColumn("grp", F.lit("all"))
    platt = asked.join(F.broadcast(fits.fit_logistic(asked, "grp", ["z"], "y").select("grp", "w")), "grp").withColumn("p", A.sigmoid(F.col("w")[0] * F.col("z") + F.col("w")[1]))
    parts = [_levels(vector, "vector", F.col("p"), True), _levels(matrix, "matrix", F.col("p"), False)]
    parts += [_moments(each, "threshold", F.col("p"), {"one": F.lit(1.0), "z": F.col("c")}), _moments(platt, "platt", F.col("p"), {"one": F.lit(1.0), "z": F.col("z")})]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query()
def fit_matrix(spark, sf_dir):
    rows = fits.standardize(S.scores(spark, sf_dir).filter("split = 'calibration'").withColumn("unit", F.lit("all")), ["unit"], "z")
    m = fits.fit_matrix(rows, "x", "y")
    w, b = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
    return spark.createDataFrame([(k, j, round(float(v), 4)) for k in range(len(b)) for j, v in enumerate([*w[k], b[k]])], "level int, feature int, weight double")


@query(f"""WITH {S.SCORES}, r AS (SELECT grp, y, split, item_id, list_transform(z, lambda v: v - list_max(z)) AS c FROM scores), u AS (SELECT grp AS fit_on, y, c FROM r WHERE split = 'calibration' UNION ALL SELECT 'POOLED', y, c FROM r WHERE split = 'calibration'),
  l AS (SELECT fit_on, g, round(avg(ln(list_sum(list_transform(c, lambda x: exp(x / exp(g))))) - c[y + 1] / exp(g)), 9) AS nll FROM (SELECT *, unnest([{", ".join(f"{g}::DOUBLE" for g in GRID)}]) AS g FROM u) GROUP BY 1, 2),
  f AS (SELECT fit_on, arg_min(g, (nll, g)) AS g FROM l GROUP BY fit_on UNION ALL SELECT 'NONE', 0.0)
  SELECT fit_on, grp, count(*) AS n, round(avg(CAST(list_position(c, list_max(c)) - 1 = y AS INT)), 6) AS accuracy, round(avg(ln(list_sum(list_transform(c, lambda x: exp(x / exp(g))))) - c[y + 1] / exp(g)), 6) AS nll FROM r, f WHERE split = 'test' GROUP BY 1, 2""")
def transfer_matrix(spark, sf_dir):
    """Accuracy and NLL on each scale's test rows under every scale's temperature, under the pooled one, and raw."""
    s = S.scores(spark, sf_dir)
    labelled = s.filter("split = 'calibration'").select(F.explode(F.array("grp", F.lit("POOLED"))).alias("fit_on"), "z", "y")
    raw = spark.createDataFrame([("NONE", 1.0)], "fit_on string, temperature double")
    fitted = fits.grid_temperature(labelled, "fit_on", "z", "y", GRID).select("fit_on", "temperature").unionByName(raw)
    pairs = fitted.agg(F.collect_list(F.struct("fit_on", "temperature")).alias("all")).withColumn("_one", F.lit(1))  # a fit for each scale
    test = s.filter("split = 'test'").withColumn("_one", F.lit(1)).join(F.broadcast(pairs), "_one").select("grp", A.centred(F.col("z")).alias("c"), "y", F.inline("all"))
    right = (A.argmax(F.col("c")) == F.col("y")).cast("int")
    return test.groupBy("fit_on", "grp").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(A.nll_at(F.col("c"), F.col("y"), F.col("temperature"))), 6).alias("nll"))


@query()
def cv_select(spark, sf_dir):
    """For each scale the candidate fit (raw, temperature, biases and temperature, matrix) of least NLL on held-out folds."""
    k = S.LEVELS
    s = S.scores(spark, sf_dir).filter("split = 'calibration'").withColumn("fold", (F.col("item_id") / 2 % 5).cast("int"))
    folds = s.select("*", F.explode(F.array(*map(F.lit, range(5)))).alias("held")).withColumn("unit", F.concat_ws("/", "grp", F.col("held").cast("string")))
    made = _candidates(folds.filter("fold <> held").select("unit", "z", "y"), k)
    held = folds.filter("fold = held").join(F.broadcast(made), "unit")
    return _chosen(held, fits.candidate_probabilities(F.col("z"), F.col("params"), k))


def _candidates(train, k: int) -> DataFrame:
    """unit, params of each unit: the flat parameters that fits.candidate_probabilities takes."""
    train = train.persist()
    t, v, m = newton.temperature(train, "unit"), newton.vector_scaling(train, "unit", k), newton.matrix_scaling(train, "unit", k)
    train.unpersist()
    return newton.params_table(train.sparkSession, "unit", "string", {u: np.r_[t[u].w, v[u].w, m[u].w.ravel(), m[u].b, m[u].mean, m[u].std] for u in t})


def _chosen(held, p: dict):
    """The mean NLL of each candidate's probabilities by scale, and the first of the best."""
    nll = held.select("grp", "y", *(v.alias(f"p{i}") for i, v in enumerate(p.values()))).groupBy("grp").agg(*(F.avg(A.nll(F.col(f"p{i}"), F.col("y"))).alias(name) for i, name in enumerate(p)))
    best = F.array_min(F.array(*(F.struct(F.col(f"`{name}`").alias("nll"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, name in enumerate(p))))
    return nll.select("grp", best["name"].alias("chosen"), *(F.round(f"`{name}`", 5).alias(name.replace("+", "_").replace("/", "_")) for name in p))


@query()
def cv_select_cumulative(spark, sf_dir):
    """The same choice for a readout of thresholds (raw, Platt for each threshold, matrix)."""
    k = S.LEVELS
    s = _calibration(spark, sf_dir).select("grp", "y", F.slice("z", 2, k - 1).alias("z"), (F.col("item_id") / 2 % 5).cast("int").alias("fold"))
    folds = s.select("*", F.explode(F.array(*map(F.lit, range(5)))).alias("held")).withColumn("unit", F.concat_ws("/", "grp", F.col("held").cast("string")))
    train = folds.filter("fold <> held").select("unit", "z", "y").persist()
    t, m = newton.threshold_platt(train, "unit", k), newton.matrix_scaling(train, "unit", k)
    train.unpersist()
    made = newton.params_table(spark, "unit", "string", {u: np.r_[t[u].ravel(), m[u].w.ravel(), m[u].b, m[u].mean, m[u].std] for u in t})
    held = folds.filter("fold = held").join(F.broadcast(made), "unit")
    z, n = F.col("z"), 2 * (k - 1)
    platt = F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda j: F.get("params", 2 * j) * F.get(z, j) + F.get("params", 2 * j + 1))
    return _chosen(held, {"raw": A.cumulative_to_levels(z), "platt/threshold": A.cumulative_to_levels(platt), "matrix": fits.matrix_probabilities(z, F.slice("params", n + 1, 1000), k, k - 1)})


SIZES, DRAWS = (8, 32, 128, 500), 20


@query()
def learning_curve(spark, sf_dir):
    """Accuracy, MAE and ECE on test rows (mean and deviation over DRAWS level-balanced draws) by the number of labels; 0 is raw."""
    k, s = S.LEVELS, S.scores(spark, sf_dir)
    labelled, most = s.filter("split = 'calibration'").select("grp", "y", "item_id", "z"), max(SIZES) // k
    number = F.xxhash64("draw", "item_id")
    w = Window.partitionBy("grp", "draw", "y").orderBy(number, "item_id")
    counts = cut(labelled.groupBy("grp", "y").agg(F.count("*").alias("c")))
    drawn = labelled.join(F.broadcast(counts), ["grp", "y"]).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    near = number.cast("double") < (3 * most / F.col("c") - 0.5) * 2.0**64  # three times as many rows as a draw takes
    first = lambda rows: rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    taken = cut(first(drawn.filter(near)))
    short = taken.groupBy("grp", "y", "draw").agg(F.count("*").alias("n"), F.first("c").alias("c")).filter(F.col("n") < F.least(F.lit(most), F.col("c")))
    groups = counts.dropna(subset=["grp", "y"]).count() * DRAWS
    if not short.isEmpty() or taken.select("grp", "y", "draw").distinct().count() < groups:  # hardly ever
        taken = cut(first(drawn))
    first = taken
    sized = first.select("*", F.explode(F.array(*(F.lit(n // k) for n in SIZES))).alias("per")).filter("r <= per")
    whole = sized.groupBy("grp", "draw", "per").agg(F.count("*").alias("rows")).filter(F.col("rows") == F.col("per") * k)  # every level has enough
    unit = sized.join(whole, ["grp", "draw", "per"]).withColumn("unit", F.concat_ws("/", "grp", F.col("per").cast("string"), F.col("draw").cast("string")))
    fitted = fits.fit_by_numpy(unit, "unit", "item_id", ["z", "y"], fits.vector_scaling).collect()  # a few numbers for each size and draw
    units = [(g, 0, [0.0] * k) for (g,) in s.select("grp").distinct().collect() if g is not None]
    for r in fitted:
        g, per, _ = r["unit"].rsplit("/", 2)
        units.append((g, int(per), r["params"]))
    by_scale: dict[str, list] = {}
    for i, (g, _, params) in enumerate(units):
        by_scale.setdefault(g, []).append((i, params))
    # rows are narrow and fits cost time: spread the rows, over some times the cores, as each task hands in sums of every unit
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    found = variants.quality(s.filter("split = 'test'"), by_scale, parts)
    both = found.join(F.broadcast(spark.createDataFrame([(i, g, per) for i, (g, per, _) in enumerate(units)], "unit int, grp string, per int")), "unit")
    shown = [f(m).alias(f"{m}{end}") for m in ("accuracy", "mae", "ece") for f, end in ((F.avg, ""), (F.stddev_pop, "_sd"))]
    return both.groupBy("grp", (F.col("per") * k).alias("size")).agg(F.count("*").alias("draws"), *shown).select("grp", "size", "draws", *(F.round(f"{m}{e}", 5).alias(f"{m}{e}") for m in ("accuracy", "mae", "ece") for e in ("", "_sd")))


def _pictures(spark, sf_dir) -> DataFrame:
    """A picture for each part; ids are narrow and pictures cost time, so the ids are spread first."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pixels.pictures(S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id")).repartition(parts, "item_id"))


@query()
def pixel_features(spark, sf_dir):
    """Image features of small synthetic pictures, made from parts."""
    return pixels.features(_pictures(spark, sf_dir))


@query()
def pixel_kernels(spark, sf_dir):
    """Mean and deviation of every part's picture after each distortion."""
    return pixels.distort(_pictures(spark, sf_dir).withColumn("kernels", F.array(*map(F.lit, sorted(pixels.KERNELS)))))


def _readout(spark, name: str, train, test, tie: str, features, y, dims, l2):
    model, k, chosen, nll = readout.choose(train, tie, features, y, dims, l2)
    scored = readout.predict(model, test.withColumn("_y", y.cast("int")), features)
    b = metrics.bundle(scored.withColumn("readout", F.lit(name)), ["readout"], "p", "_y")
    shown = b.select("readout", F.lit(k).cast("int").alias("dims"), F.lit(chosen).alias("l2"), F.lit(round(nll, 5)).alias("cv_nll"), "n", *(F.round(c, 5).alias(c) for c in ("accuracy", "within_one", "mae", "nll")))
    return shown


@query()
def readout_ladder(spark, sf_dir):
    """Hidden vectors to labels: principal components and penalty by cross-validation, then test metrics."""
    v = S.read(spark, sf_dir, "embeddings")
    split = F.col("vec_id") % 2 == 0
    return _readout(spark, "components", v.filter(split), v.filter(~split), "vec_id", F.transform("embedding", lambda x: x.cast("double")), F.col("label"), [8, 32], [0.001, 0.05])


@query()
def feature_classifier(spark, sf_dir):
    """The level of a distortion (noise, four levels) from 29 picture features."""
    rows = pixels.laddered(_pictures(spark, sf_dir), "ladder_noise").persist()
    names = [c for c in rows.columns if c not in ("item_id", "level")]
    split = F.col("item_id") % 2 == 0
    return _readout(spark, "features", rows.filter(split), rows.filter(~split), "item_id", F.array(*names), F.col("level"), None, [0.001, 0.05])
