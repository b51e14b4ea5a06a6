"""URL filter: rules by host and path, and blocks that reach the aliases of a URL by redirects and canonical links.

A rule decides about the URLs of its host and all subdomains whose path starts with its path; the longest rule wins, of
equally long ones an allow. URLs that redirect to each other or name each other as canonical are one component (found by
rounds of smallest neighbours, see graph). A URL without a rule is blocked if a rule blocks a URL of its component and
none allows one: an explicit allow comes before every block that is only passed on.

Nulls: a null URL, or one without `://`, has an empty host and path, no rule and no aliases: it is allowed. Null html has
no links. Every row gives one row, repeated ones too; empty tables give none; columns beyond page_id, url and html are
ignored. Aliases are URLs up to the case of scheme and host, without the fragment.
"""
from __future__ import annotations

import html as entities
import re
import string
from collections.abc import Iterator, Sequence
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm._common import cut, drop, give_back, slices, small_batches, table
from calibra.llm.graph import components

#: The rules of the query, as (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
RULE = "verdict string, host string, path string"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The URL as its aliases name it; null if it is none."""
    rest = F.regexp_extract(_rest(url), "^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(ascii_lower(F.substring_index(url, "://", 1)), F.lit("://"), host_of(url), rest))


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _by_list(rules: Sequence[tuple[str, str, str]]) -> Column:
    """The deciding rule as a struct, of few rules that are part of the plan."""
    best_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1]))
    known = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in best_first])
    fits = lambda r: ((F.col("host") == r["host"]) | F.endswith("host", F.concat(F.lit("."), r["host"]))) & F.startswith("path", r["path"])
    return F.get(F.filter(known, fits), 0)


def _by_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, decided of the (host, path) that a rule fits, by joins on equal hosts and on equal beginnings of paths."""
    rules = rules.select("verdict", F.col("host").alias("r_host"), F.col("path").alias("r_path")).filter("verdict is not null and r_host is not null and r_path is not null").distinct()
    lengths = rules.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))  # at most as many as a URL has characters
    near = urls.select("host", "path").filter("host <> ''").distinct().select("host", "path", F.explode(_suffixes(F.col("host"))).alias("r_host")).join(lengths, "r_host")
    begun = near.select("host", "path", "r_host", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")).withColumn("r_path", F.substring("path", F.lit(1), F.col("n")))
    rank = F.struct(F.length("r_host") + F.length("r_path"), (F.col("verdict") == "allow").alias("allow"), F.length("r_path"))
    return begun.join(rules, ["r_host", "r_path"]).groupBy("host", "path").agg(F.max_by(F.struct("verdict", F.col("r_host").alias("host"), F.col("r_path").alias("path")), rank).alias("decided"))


def decide(urls: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """urls (with columns host and path) and `decided`, the struct of the rule that fits best, null if none does.

    Rules in a list become part of the plan: give at most some hundreds. Any number of rules comes as a table.
    """
    if isinstance(rules, DataFrame):
        return urls.join(_by_table(urls, rules), ["host", "path"], "left")
    return urls.withColumn("decided", _by_list(rules) if rules else F.lit(None).cast(f"struct<{RULE.replace(' string', ': string')}>"))


_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(link|meta|base)\b((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.I | re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+))")
_REFRESH = re.compile(r"\s*[\d.]++\s*[;,]?\s*(?:url\s*=\s*)?[\"']?([^\"']+)", re.I)


def aliases(url: str, html: str) -> list[str]:
    """The canonical links and the refresh redirects of a page, as full URLs."""
    base, out = url, []
    for tag in _TAG.finditer(html):
        if not tag[2]:
            continue
        at: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(tag[3]):
            at.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        kind, to = tag[2].lower(), None
        try:
            if kind == "base" and at.get("href") and base == url:
                base = urljoin(url, at["href"].strip())
            elif kind == "link" and "canonical" in at.get("rel", "").lower().split():
                to = at.get("href", "").strip()
            elif kind == "meta" and at.get("http-equiv", "").strip().lower() == "refresh" and (m := _REFRESH.match(at.get("content", ""))):
                to = m[1].strip()
            if to:
                out.append(urljoin(base, to))
        except ValueError:  # no valid URL: no alias
            pass
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        pairs = [(u, a) for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True) for a in aliases(u, h)]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["from_url", "to_url"])
    give_back()


def page_links(pages: DataFrame) -> DataFrame:
    """from_url, to_url of the redirects and canonical links in the html of pages; only pages that may have one go to Python."""
    small_batches(pages)
    some = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).filter("instr(url, '://') > 0").filter(F.col("html").rlike("(?i)canonical|refresh"))
    return some.mapInArrow(_links, "from_url string, to_url string")


def blocked_aliases(links: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """node: the URLs of links whose component has a URL that a rule blocks and none that a rule allows."""
    edges = links.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).filter("a <> b")
    nodes = components(edges)
    judged = decide(nodes.withColumn("host", host_of(F.col("node"))).withColumn("path", path_of(F.col("node"))), rules)
    is_ = lambda verdict: F.max(F.coalesce(F.col("decided.verdict") == verdict, F.lit(False)))
    bad = judged.groupBy("comp").agg(is_("block").alias("block"), is_("allow").alias("allow")).filter("block and not allow").select("comp")
    return nodes.join(bad, "comp", "left_semi").select("node")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; redirects (from_url, to_url) of a crawl count beside the pages' own links."""
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("from_url").cast("string"), F.col("to_url").cast("string")))
    links = cut(links)
    bad = cut(blocked_aliases(links, rules))
    drop(links)
    url = F.col("url").cast("string")
    judged = decide(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node")), rules)
    passed_on = judged.join(bad.withColumn("bad", F.lit(True)), "node", "left")
    rule = F.concat("decided.host", "decided.path")
    return passed_on.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("decided.verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql_parts(url: str) -> str:
    rest = f"substr({url}, instr({url}, '://') + 3)"
    return f"""CASE WHEN instr({url}, '://') > 0 THEN translate(regexp_extract({rest}, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') ELSE '' END AS host,
    CASE WHEN instr({url}, '://') > 0 THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path"""


def _sql_node(url: str) -> str:
    rest = f"substr({url}, instr({url}, '://') + 3)"
    lower = lambda x: f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"CASE WHEN instr({url}, '://') > 0 THEN {lower(f'''substr({url}, 1, instr({url}, '://') - 1)''')} || '://' || {lower(f'''regexp_extract({rest}, '^[^/?#]*')''')} || regexp_extract({rest}, '^[^/?#]*([^#]*)', 1) END"


_VALUE = """(?:"([^"]*)"|''([^'']*)''|([^\\s"''<>]+))"""
_SQL_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
QUERIES = {"op11_url_filter": op11_url_filter}
#: Links are absolute URLs, or begin with `/` or `//`, in the SQL.
ORACLES = {
    "op11_url_filter": f"""
WITH RECURSIVE rules(verdict, r_host, r_path) AS (VALUES {_SQL_RULES}),
tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(?:-->|$)|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g'), '(?is)<(?:link|meta)\\b[^>]*>')) AS tag
  FROM pages WHERE instr(url, '://') > 0),
raw AS (
  SELECT url, trim(concat(regexp_extract(tag, '(?i)\\bhref\\s*=\\s*{_VALUE}', 1), regexp_extract(tag, '(?i)\\bhref\\s*=\\s*{_VALUE}', 2), regexp_extract(tag, '(?i)\\bhref\\s*=\\s*{_VALUE}', 3))) AS t
  FROM tags WHERE regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?[^"''>]*\\bcanonical\\b')
  UNION ALL
  SELECT url, trim(regexp_extract(tag, '(?i)\\bcontent\\s*=\\s*["'']?\\s*[\\d.]+\\s*[;,]\\s*url\\s*=\\s*["'']?([^"''>]+)', 1))
  FROM tags WHERE regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh')),
links AS (
  SELECT url, CASE WHEN t LIKE '%://%' THEN t WHEN t LIKE '//%' THEN substr(url, 1, instr(url, ':')) || t
    ELSE regexp_extract(url, '^.*?://[^/?#]*') || t END AS t
  FROM raw WHERE t LIKE '%://%' OR t LIKE '/%'),
pairs AS (SELECT {_sql_node("url")} AS a, {_sql_node("t")} AS b FROM links),
edges AS (SELECT a, b FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
known AS (
  SELECT u, host, path, r_host || r_path AS rule, verdict
  FROM (SELECT u, {_sql_parts("u")} FROM (SELECT DISTINCT url AS u FROM pages UNION SELECT other FROM reach)) LEFT JOIN rules
    ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  QUALIFY row_number() OVER (PARTITION BY u ORDER BY length(r_host || r_path) DESC NULLS LAST, verdict) = 1),
bad AS (
  SELECT r.node FROM reach r JOIN known k ON k.u = r.other GROUP BY r.node
  HAVING bool_or(coalesce(k.verdict = 'block', false)) AND NOT bool_or(coalesce(k.verdict = 'allow', false)))
SELECT p.page_id, k.host, k.path, k.rule, coalesce(k.verdict, CASE WHEN b.node IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM pages p JOIN known k ON k.u IS NOT DISTINCT FROM p.url LEFT JOIN bad b ON b.node = {_sql_node("p.url")}
"""
}
