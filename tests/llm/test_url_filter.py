from __future__ import annotations

import random
import re

import duckdb
import pytest

from calibra.llm import url_filter

SCHEMA = "page_id long, url string, html string, host string, rule int, node string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(url, rules):
    host, path = split(url)
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return min(fits, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", -len(r[2])), default=None)


def node(url):
    if url is None or "://" not in url:
        return None
    scheme, rest = url.split("://", 1)
    host, tail = re.match(r"([^/?#]*)([^#]*)", rest).groups()
    return f"{scheme.lower()}://{host.lower()}{tail}"


def brute(pages, links, rules):
    near = {}
    for a, b in links:
        a, b = node(a), node(b)
        if a and b and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = []
    for page_id, url, *_ in pages:
        seen, todo = set(), [node(url)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near.get(n, ())
        verdicts = {r[0] for n in seen if n and (r := rule_of(n, rules))}
        own = rule_of(url, rules)
        out.append((page_id, *split(url), own[1] + own[2] if own else None, own[0] if own else "block" if "block" in verdicts and "allow" not in verdicts else "allow"))
    return out


def canonical(to):
    return f'<html><head><LINK href="{to}" title="a>b" rel="nofollow Canonical"></head></html>'


def site():
    """Pages of chains, stars and circles; (pages, links)."""
    r = random.Random(4)
    urls = [f"{r.choice(['http', 'HTTPS'])}://{r.choice(['', 'www.', 'Blog.'])}{h}.Example.{t}/{lang}/{i}{r.choice(['', '#top', '?page=2', '/'])}" for i, (h, t, lang) in enumerate((r.choice("abcd"), r.choice(["org", "com", "net"]), r.choice(["en", "es", "de", "fr"])) for _ in range(300))]
    links = [(urls[i], urls[i + 1 + i % 3]) for i in range(0, 200, 2)] + [(urls[i], urls[210]) for i in range(211, 260)] + [(urls[i], urls[i]) for i in (1, 3, 5)] + [("https://x.net/1", "https://y.com/de/z")]
    to = dict(links)
    pages = [(i, u, canonical(to[u]) if u in to else "<p>canonical</p>", "clash", 1, "clash") for i, u in enumerate(urls)] + [(900, "https://x.net/1", canonical("https://y.com/de/z"), None, None, None)]
    pages += [(1000, None, canonical("https://y.com/de/z"), None, None, None), (1001, "no scheme", None, None, None, None), (1002, "", "", None, None, None), (None, "https://x.net/1#frag", None, None, None, None), (1003, "http://org", None, None, None, None), (1004, "http://org/", None, None, None, None)]
    pages += [(1005, "http://notexample.org?x/es/", None, None, None, None), (1006, "http://example.org/es/1", None, None, None, None), (1007, "http://a.ORG:80/es/", None, None, None, None), (1008, "http://É.com/de/", None, None, None, None), (0, urls[0], None, None, None, None), (0, urls[0], None, None, None, None)]
    return pages, links


def rows(df):
    assert df.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_same_as_brute_force_and_sql(spark, tmp_path):
    pages, links = site()
    want = sorted(brute(pages, links, url_filter.RULES), key=repr)
    assert {(v, r is None) for *_, r, v in want} == {("allow", False), ("block", False), ("allow", True), ("block", True)}
    spark.createDataFrame(pages, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert rows(url_filter.op11_url_filter(spark, str(tmp_path))) == want
    con = duckdb.connect()
    plain = [(p[0], p[1], p[2].replace("a>b", "a") if p[2] else p[2]) for p in pages]
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", plain)
    found = con.execute(url_filter.ORACLES["op11_url_filter"])
    assert [d[0] for d in found.description] == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(found.fetchall(), key=repr) == want


def test_links_of_a_crawl_and_many_rules(spark):
    pages, links = site()
    r = random.Random(8)
    rules = [(r.choice(["allow", "block"]), h, p) for h in ("org", "com", "example.net", "a.example.com", "www.b.example.org", "zzz") for p in r.sample(["/", "/e", "/en/1", "/es/", "/de/2", "/fr/", "", "/en"], 5)]
    logged = spark.createDataFrame([*links, (None, "http://a.org/"), ("http://a.org/", None), ("http://q.net/", "nothing")], "from_url string, to_url string")
    bare = spark.createDataFrame([(p[0], p[1], None, None, None, None) for p in pages], SCHEMA)
    want = sorted(brute(pages, links, rules), key=repr)
    assert rows(url_filter.judge(bare, rules, logged)) == want
    table = spark.createDataFrame([*rules, *rules[:3], (None, "org", "/"), ("block", None, "/"), ("block", "org", None)], url_filter.RULE)
    assert rows(url_filter.judge(bare, table, logged)) == want
    assert {row[4] for row in rows(url_filter.judge(bare, [], logged))} == {"allow"}


@pytest.mark.parametrize(
    "html, want",
    [
        ("<link rel=canonical href=/a/../b?x=1&amp;y>", ["https://s.net/b?x=1&y"]),
        ("<LINK REL='canonical' HREF='//Other.net/q'>", ["https://Other.net/q"]),
        ('<link rel="alternate" href="/no"><link rel="canonicals" href="/no"><link rel="canonical">', []),
        ('<!-- <link rel="canonical" href="/no"> --><script>"<link rel=canonical href=/no>"</script><link data-x="a>b" rel="canonical" href="yes">', ["https://s.net/dir/yes"]),
        ('<meta http-equiv="Refresh" content="0; URL=\'/there\'">', ["https://s.net/there"]),
        ('<meta http-equiv="refresh" content="30"><meta name="refresh" content="0;url=/no">', []),
        ('<base href="https://base.org/x/"><link rel="canonical" href="y">', ["https://base.org/x/y"]),
        ('<link rel="canonical" href="http://[bad">', []),
        ("<!-- open <link rel=canonical href=/no>", []),
    ],
)
def test_aliases(html, want):
    assert url_filter.aliases("https://s.net/dir/page", html) == want


def test_empty_table(spark):
    assert rows(url_filter.judge(spark.createDataFrame([], SCHEMA))) == []
