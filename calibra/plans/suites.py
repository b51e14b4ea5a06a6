"""Suites over stand-in rows of the tables: the items a run would ask."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.operators import layout, suites
from calibra.plans._register import Registry
from calibra.sources import standins as S

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _shown(*items: DataFrame) -> DataFrame:
    rows = [i.select("suite", "item_id", "question", F.concat_ws("|", "keys").alias("keys"), "label", "split") for i in items]
    return reduce(lambda a, b: a.unionByName(b), rows)


def _sql(inner: str) -> str:
    """inner: suite, item_id, question, keys, label. Adds the split that alternates in the seeded order."""
    return f"""SELECT suite, item_id, question, keys, label, CASE WHEN (row_number() OVER (PARTITION BY suite ORDER BY md5(item_id || ':7'), item_id) - 1) % 2 = 0 THEN 'calibration' ELSE 'test' END AS split FROM ({inner})"""


def _asked(spark, sf_dir) -> DataFrame:
    d = S.read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("item_id"), F.concat(F.lit("Is there a "), "source", F.lit(" in the image?")).alias("text"), F.when(F.col("n_chars") % 2 == 1, "yes").otherwise("No ").alias("answer"))


_ASKED = "SELECT CAST(doc_id AS VARCHAR) AS item_id, 'There is a ' || source || ' in the image.' AS question, '' AS keys, CASE WHEN n_chars % 2 = 1 THEN 'true' ELSE 'false' END AS label FROM documents"


@query(_sql(f"SELECT 'yes_no_objects' AS suite, * FROM ({_ASKED})"))
def suite_yes_no_objects(spark, sf_dir):
    return _shown(suites.yes_no_objects(_asked(spark, sf_dir)))


@query(_sql(f"SELECT * FROM (SELECT 'yes_no_objects' AS suite, * FROM ({_ASKED})) QUALIFY row_number() OVER (ORDER BY md5(item_id || ':7'), item_id) <= 60"))
def suite_first_items(spark, sf_dir):
    return _shown(suites.yes_no_objects(_asked(spark, sf_dir), 60))


@query(f"""SELECT 'injection' AS suite, item_id, question, keys, label, split, unnest(['clean', 'injected']) AS variant FROM (SELECT * FROM ({_sql(f"SELECT 'x' AS suite, * FROM ({_ASKED})")}) WHERE label = 'false' QUALIFY row_number() OVER (ORDER BY md5(item_id || ':7'), item_id) <= 50)""")
def suite_injection(spark, sf_dir):
    items = suites.injection(_asked(spark, sf_dir), 50)
    return items.select("suite", "item_id", "question", F.concat_ws("|", "keys").alias("keys"), "label", "split", "variant")


@query(_sql("SELECT 'yes_no_scenes' AS suite, CAST(doc_id AS VARCHAR) AS item_id, 'About img0: Is it ' || lang || '?' AS question, '' AS keys, CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END AS label FROM documents WHERE doc_id % 3 < 2"))
def suite_yes_no_scenes(spark, sf_dir):
    d, i = S.read(spark, sf_dir, "documents"), F.col("doc_id") % 3
    rows = d.select(F.col("doc_id").alias("item_id"), F.concat(F.lit("Is it "), "lang", F.lit("?")).alias("text"), F.when(i == 0, "Yes").when(i == 1, " no").otherwise("maybe").alias("answer"))
    return _shown(suites.yes_no_scenes(rows))


def _brands(spark, sf_dir) -> DataFrame:
    return S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("label"))


_BRANDS = "k AS (SELECT list_sort(list(DISTINCT p_brand)) AS keys FROM part WHERE p_brand <> 'Brand#11'), b AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_brand AS label, keys FROM part, k WHERE p_brand <> 'Brand#11')"


@query(f"WITH {_BRANDS} " + _sql("SELECT 'many_options' AS suite, item_id, 'What is shown?' AS question, array_to_string(keys, '|') AS keys, label FROM b"))
def suite_many_options(spark, sf_dir):
    return _shown(suites.many_options(_brands(spark, sf_dir), drop="Brand#11"))


@query(f"""WITH {_BRANDS}, o AS (SELECT list_transform(list_sort(list_transform(keys, lambda x: md5(x || ':7') || x))[1:7], lambda x: x[33:]) AS out FROM k)
  """ + _sql("SELECT 'open_set' AS suite, item_id, 'What is shown?' AS question, array_to_string(list_append(list_filter(keys, lambda x: NOT list_contains(out, x)), 'other'), '|') AS keys, CASE WHEN list_contains(out, label) THEN 'other' ELSE label END AS label FROM b, o"))
def suite_open_set(spark, sf_dir):
    return _shown(suites.open_set_of(*suites.options(_brands(spark, sf_dir), "Brand#11")))


@query("WITH c AS (SELECT unnest(['red', 'green', 'blue', 'grey']) AS c), i AS (SELECT p_partkey, ['red', 'green', 'blue', 'grey'][p_size % 4 + 1] AS own FROM part), o AS (SELECT p_partkey, own, list_sort(list(c)) AS others FROM i JOIN c ON c <> own GROUP BY 1, 2), b AS (SELECT p_partkey, own AS c, 'true' AS label FROM i UNION ALL SELECT p_partkey, others[CAST(CAST('0x' || substr(md5(p_partkey || ':7'), 1, 13) AS BIGINT) % 3 AS INT) + 1], 'false' FROM o) " + _sql("SELECT 'own_or_other' AS suite, p_partkey || '/' || c AS item_id, 'This is a ' || c || '.' AS question, '' AS keys, label FROM b"))
def suite_own_or_other(spark, sf_dir):
    names = ["red", "green", "blue", "grey"]
    rows = S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.get(F.array(*map(F.lit, names)), F.col("p_size") % 4).alias("label"))
    return _shown(suites.own_or_other(rows, names))


@query("""WITH k AS (SELECT list_sort(list(DISTINCT c_name)) AS keys FROM (SELECT c_name FROM customer ORDER BY c_custkey LIMIT 60)), i AS (SELECT CAST(c_custkey AS VARCHAR) AS item_id, c_name AS label, keys FROM customer, k WHERE c_custkey <= (SELECT max(c_custkey) FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 60))),
  h AS (SELECT *, list_transform(list_sort(list_transform(keys, lambda x: CASE WHEN x = label THEN '!' ELSE md5(item_id || '/' || x || ':7') END || '~' || x))[1:26], lambda x: split_part(x, '~', 2)) AS kept FROM i)
  SELECT item_id, array_to_string(list_filter(keys, lambda x: list_contains(kept, x)), '|') AS keys, label FROM h""")
def letter_subset(spark, sf_dir):
    first = S.read(spark, sf_dir, "customer").orderBy("c_custkey").limit(60).select(F.col("c_custkey").cast("string").alias("item_id"), F.col("c_name").alias("label"))
    items = suites.many_options(first, drop="")
    return suites.letter_subset(items).select("item_id", F.concat_ws("|", "keys").alias("keys"), "label")


@query("""WITH g AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, 'How good is ' || p_brand || '?' AS question, 'bad|good' AS keys, CASE WHEN p_size % 2 = 0 THEN 'bad' ELSE 'good' END AS label, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_size % 2 = p_partkey % 2 THEN 0.0::DOUBLE ELSE round(1 / 3::DOUBLE, 6) END AS disagreement, 'human_gold' AS suite FROM part)
  SELECT a.*, disagreement FROM (""" + _sql("SELECT suite, item_id, question, keys, label FROM g") + ") a JOIN g USING (item_id)")
def suite_human_gold(spark, sf_dir):
    pick = lambda c: F.when(c % 2 == 0, "bad").otherwise("good")
    one = pick(F.col("p_size"))
    votes = F.when(F.col("p_partkey") % 5 == 0, F.create_map(F.lit("a"), one)).otherwise(F.create_map(F.lit("a"), one, F.lit("b"), one, F.lit("c"), pick(F.col("p_partkey"))))
    rows = S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.concat(F.lit("How good is "), "p_brand", F.lit("?")).alias("question"), F.array(F.lit("bad"), F.lit("good")).alias("keys"), one.alias("label"), votes.alias("annotators"))
    return suites.human_gold(rows).select("suite", "item_id", "question", F.concat_ws("|", "keys").alias("keys"), "label", "split", F.round("disagreement", 6).alias("disagreement"))


@query("SELECT 'ladder_' || s AS suite, CAST(p_partkey AS VARCHAR) AS item_id, 'How strong is the ' || s || '?' AS question, 'none|slight|strong|severe' AS keys, CAST(p_size % 4 AS VARCHAR) AS label, CASE WHEN p_partkey % 2 = 0 THEN 'calibration' ELSE 'test' END AS split FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 80), (SELECT unnest(['blur', 'noise', 'jpeg', 'exposure', 'resolution']) AS s)")
def suite_ladders(spark, sf_dir):
    part = S.read(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("item_id"), (F.col("p_size") % 4).alias("level"), F.when(F.col("p_partkey") % 2 == 0, "calibration").otherwise("test").alias("split"))
    return _shown(*(suites.REGISTRY[f"ladder_{k}"](rows, f"How strong is the {k}?", ["none", "slight", "strong", "severe"], 80) for k in suites.LADDERS))


@query("WITH i AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY md5(p_partkey || ':7'), CAST(p_partkey AS VARCHAR)) AS r FROM part) SELECT p_partkey AS item_id, CAST((r - 41) % 4 AS INT) AS level FROM i WHERE r > 40")
def suite_blur_ladder(spark, sf_dir):
    rows = S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))
    return suites.tail(rows, 40).select("item_id", "level")


@query(_sql(" UNION ALL ".join(f"SELECT 'probe_{n}' AS suite, CAST(p_partkey AS VARCHAR) AS item_id, '{q}' AS question, '{'|'.join(keys)}' AS keys, ['{"', '".join(keys)}'][p_size % {len(keys)} + 1] AS label FROM part" for n, (q, keys) in suites.PROBES.items())))
def suite_probes(spark, sf_dir):
    part, made = S.read(spark, sf_dir, "part"), []
    for name, (_, keys) in suites.PROBES.items():
        rows = part.select(F.col("p_partkey").alias("item_id"), F.get(F.array(*map(F.lit, keys)), F.col("p_size") % len(keys)).alias("label"))
        made.append(suites.REGISTRY[f"probe_{name}"](rows))
    return _shown(*made)


@query(_sql("SELECT 'probe_spatial' AS suite, CAST(p_partkey AS VARCHAR) AS item_id, 'Is the ball left of the ' || p_brand || '?' AS question, '' AS keys, CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS label FROM part UNION ALL SELECT 'probe_text', CAST(p_partkey AS VARCHAR), 'Which word is printed in `img0`?', p_name || '|' || p_brand || '|' || p_type, p_brand FROM part"))
def suite_probes_by_item(spark, sf_dir):
    part = S.read(spark, sf_dir, "part").withColumn("item_id", F.col("p_partkey"))
    spatial = part.select("item_id", (F.col("p_size") > 25).alias("label"), F.concat(F.lit("Is the ball left of the "), "p_brand", F.lit("?")).alias("question"))
    words = part.select("item_id", F.col("p_brand").alias("label"), F.array("p_name", "p_brand", "p_type").alias("words"))
    return _shown(suites.probe_spatial(spatial), suites.probe_text(words))


_STATE = """SELECT c_custkey, box, unnest([{'k': 'signed_in', 'v': c_custkey % 3 > 0}, {'k': 'error_shown', 'v': c_custkey % 4 = 0}, {'k': 'cookie_banner', 'v': c_custkey % 5 = 0}, {'k': 'checkbox_checked', 'v': c_custkey % 2 = 0}]) AS s FROM (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS box FROM customer)"""


@query(f"""WITH RECURSIVE s AS (SELECT c_custkey, box, s.k AS k, s.v AS v, md5(c_custkey || '__' || s.k || ':7') AS h FROM ({_STATE}) WHERE s.k <> 'checkbox_checked' OR box IS NOT NULL),
  o AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY h) AS i, row_number() OVER (PARTITION BY c_custkey ORDER BY v, h) AS falling, row_number() OVER (PARTITION BY c_custkey ORDER BY NOT v, h) AS rising FROM s),
  g AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r, sum(CASE WHEN v THEN 1 ELSE -1 END) FILTER (i <= 2) AS zero, sum(CASE WHEN v THEN 1 ELSE -1 END) FILTER (falling <= 2) AS above, sum(CASE WHEN v THEN 1 ELSE -1 END) FILTER (rising <= 2) AS below FROM o GROUP BY c_custkey),
  d AS (SELECT CAST(1 AS BIGINT) AS r, CAST(0 AS BIGINT) AS d UNION ALL SELECT d.r + 1, CAST(d.d + CASE WHEN d.d > 0 THEN above WHEN d.d < 0 THEN below ELSE zero END AS BIGINT) FROM d JOIN g USING (r)),
  p AS (SELECT o.* FROM o JOIN g USING (c_custkey) JOIN d USING (r) WHERE CASE WHEN d.d > 0 THEN falling WHEN d.d < 0 THEN rising ELSE i END <= 2) """ + _sql("SELECT 'ui_state' AS suite, c_custkey || '__' || k AS item_id, CASE k " + " ".join(f"WHEN '{k}' THEN '{q}'" for k, q in suites.STATES.items()) + """ ELSE 'Is the "' || box || '" checkbox checked in `img0`?' END AS question, '' AS keys, CASE WHEN v THEN 'true' ELSE 'false' END AS label FROM p"""))
def suite_ui_state(spark, sf_dir):
    i = F.col("c_custkey")
    states = F.create_map(F.lit("signed_in"), i % 3 > 0, F.lit("error_shown"), i % 4 == 0, F.lit("cookie_banner"), i % 5 == 0, F.lit("checkbox_checked"), i % 2 == 0)
    rows = S.read(spark, sf_dir, "customer").select(i.alias("screen_id"), states.alias("states"), F.when(i % 7 != 0, F.col("c_mktsegment")).alias("checkbox_label"))
    return _shown(suites.ui_state(rows))


_PAGES = ["form", "list", "article", "checkout", "settings"]


@query(_sql(f"""SELECT 'ui_page' AS suite, CAST(c_custkey AS VARCHAR) AS item_id, 'What kind of page is `img0`?' AS question, '{"|".join(_PAGES)}' AS keys, ['{"', '".join(_PAGES)}'][c_nationkey % 5 + 1] AS label FROM customer
  UNION ALL SELECT 'ui_click', CAST(c_custkey AS VARCHAR), 'Goal: ' || c_mktsegment || '. Which numbered element in `img0` should be clicked?', array_to_string(range(1, 4 + c_custkey % 3), '|'), CAST(1 + c_custkey % 3 AS VARCHAR) FROM customer
  UNION ALL SELECT 'ui_done', CAST(c_custkey AS VARCHAR), 'Goal: ' || c_mktsegment || '. Has this goal already been accomplished on the screen in `img0`?', '', CASE WHEN c_nationkey % 2 = 0 THEN 'true' ELSE 'false' END FROM customer
  UNION ALL SELECT 'ui_reason', CAST(c_custkey AS VARCHAR), 'Why ' || c_name || '?', 'a|b|c', ['a', 'b', 'c'][c_custkey % 3 + 1] FROM customer"""))
def suite_ui_screens(spark, sf_dir):
    i = F.col("c_custkey")
    c = S.read(spark, sf_dir, "customer").withColumn("screen_id", i)
    pages = F.get(F.array(*map(F.lit, _PAGES)), F.col("c_nationkey") % 5)
    click = c.select("screen_id", F.col("c_mktsegment").alias("goal"), (3 + i % 3).alias("n_marks"), (1 + i % 3).alias("target"))
    done = c.select("screen_id", F.col("c_mktsegment").alias("goal"), (F.col("c_nationkey") % 2 == 0).alias("done"))
    options = F.array(*map(F.lit, "abc"))
    reason = c.select("screen_id", F.concat(F.lit("Why "), "c_name", F.lit("?")).alias("question"), options.alias("options"), F.get(options, (i % 3).cast("int")).alias("answer"))
    return _shown(suites.ui_page(c.withColumn("page_type", pages), _PAGES), suites.ui_click(click), suites.ui_done(done), suites.ui_reason(reason))


@query("SELECT s.suite, b.backend, unnest(CASE WHEN s.type = 'choice' AND b.letters THEN ['independent', 'letter'] ELSE ['independent'] END) AS method, CASE WHEN b.hosted THEN 'test' ELSE 'all' END AS splits FROM (SELECT n_name AS suite, ['noul', 'choice', 'score'][n_nationkey % 3 + 1] AS type, n_regionkey = 0 AS private FROM nation) s, (SELECT r_name AS backend, r_regionkey % 2 = 0 AS letters, r_regionkey = 4 AS hosted, r_regionkey < 2 AS allow FROM region) b WHERE NOT s.private OR b.allow")
def plan_units(spark, sf_dir):
    n, r = S.read(spark, sf_dir, "nation"), S.read(spark, sf_dir, "region")
    asked = n.select(F.col("n_name").alias("suite"), F.get(F.array(*map(F.lit, ("noul", "choice", "score"))), F.col("n_nationkey") % 3).alias("type"), (F.col("n_regionkey") == 0).alias("private"))
    k = F.col("r_regionkey")
    return suites.plan(asked, r.select(F.col("r_name").alias("backend"), (k % 2 == 0).alias("letters"), (k == 4).alias("hosted"), (k < 2).alias("allow_private")))


_WITHIN = "{low} + (({n} * ({high} - ({low}))) >> 28)"


def _hex(digest: str, at: int, digits: int = 7) -> str:
    return f"('0x' || substr({digest}, {at}, {digits}))::BIGINT"


_RADIUS = _WITHIN.format(n=_hex("md5(item_id || ':' || attempt || ':' || d)", 1), low=layout.RADIUS[0], high=layout.RADIUS[1])
_EDGE = f"(s.r + {layout.BORDER})"
_TRY = "md5(item_id || ':' || attempt || ':' || s.disc || ':' || t)"


@query(f"""WITH RECURSIVE items AS (SELECT item_id, (row_number() OVER (ORDER BY h, item_id) - 1) % 8 + 1 AS n FROM (SELECT p_partkey AS item_id, {_hex("md5(p_partkey || ':count')", 1, 13)} AS h FROM part)),
  walk AS (SELECT item_id, n, 0 AS attempt, 0 AS t, []::STRUCT(disc INT, r BIGINT, x BIGINT, y BIGINT)[] AS placed FROM items UNION ALL
    SELECT item_id, n, CASE WHEN NOT fits AND t + 1 = {layout.TRIES} THEN attempt + 1 ELSE attempt END, CASE WHEN fits OR t + 1 = {layout.TRIES} THEN 0 ELSE t + 1 END,
      CASE WHEN fits THEN list_append(placed, c) WHEN t + 1 = {layout.TRIES} THEN [] ELSE placed END FROM (
        SELECT *, len(list_filter(placed, lambda q: (q.x - c.x) * (q.x - c.x) + (q.y - c.y) * (q.y - c.y) < (q.r + c.r + {layout.GAP}) * (q.r + c.r + {layout.GAP}))) = 0 AS fits FROM (
          SELECT item_id, n, attempt, t, placed, {{'disc': s.disc, 'r': s.r, 'x': {_WITHIN.format(n=_hex(_TRY, 1), low=_EDGE, high=f"{layout.WIDTH} - {_EDGE}")}, 'y': {_WITHIN.format(n=_hex(_TRY, 8), low=_EDGE, high=f"{layout.HEIGHT} - {_EDGE}")}}}::STRUCT(disc INT, r BIGINT, x BIGINT, y BIGINT) AS c FROM (
            SELECT *, list_sort(list_transform(range(n), lambda d: {{'m': -({_RADIUS}), 'r': {_RADIUS}, 'disc': d}}))[len(placed) + 1] AS s FROM walk WHERE len(placed) < n AND attempt < {layout.ATTEMPTS}))))
  SELECT item_id, CAST(n AS INT) AS discs, attempt, p.disc AS disc, p.r AS r, p.x AS x, p.y AS y FROM (SELECT item_id, n, attempt, unnest(placed) AS p FROM walk WHERE len(placed) = n)""")
def probe_layouts(spark, sf_dir):
    parts = S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))
    counts = layout.balanced(parts, "item_id", 8).withColumnRenamed("value", "discs")
    return layout.layouts(counts, "item_id", "discs")[0]
