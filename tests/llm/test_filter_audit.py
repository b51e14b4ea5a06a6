from __future__ import annotations

import itertools
import re

import duckdb

from calibra.llm import filter_audit

DOCS = "doc_id long, text string, source string, words string, pattern long"
LABELS = "doc_id long, quality int, toxic int, n int"


def brute(docs, labels):
    good, toxic = {i for i, q, *_ in labels if i is not None and q == 1}, {i for i, _, t, *_ in labels if i is not None and t == 1}
    lowest = {}
    for i, text, *_ in docs:
        if i is not None:
            lowest[text or ""] = min(lowest.get(text or "", i), i)
    parts = {}
    for i, text, source, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and lowest[text] < i,
        }
        parts.setdefault(source or "", []).append((i, {f for f, bad in fails.items() if bad}))
    out = []
    for part, rows in parts.items():
        removed, mine = {f: 0 for f in "ABCDE"}, []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [i for i, fails in left if f in fails]
                left = [r for r in left if f not in r[1]]
                removed[f] += len(gone)
                mine.append([part, order, step, len(left), len(gone), sum(f in fails for _, fails in rows) - len(gone), sum(fails == {f} for _, fails in rows), sum(i in good for i in gone), sum(i in toxic for i in gone)])
        out += [tuple(r) + (removed[r[1][r[2] - 1]],) for r in mine]
    return out


def table():
    words = [f"w{i}" for i in range(400)]
    texts = [
        " ".join(words), " ".join(words[:199]), "\t".join(words[:200]), " ".join(words[:60] * 4), " ".join(words[:100] * 2), "UPPER " * 300, " ".join(words) + " # | x", None, "", " \x0b \r\n", "cost $5",
        "a b c\xa0d " * 90, "É" * 30, "Ab" + "c" * 98, "Ab" + "c" * 97 + " A", "x " * 60_000, "<>\x1c\x85 y",
    ]
    docs = [(i, t, [None, "", "src", "weird"][i % 4], "clash", i) for i, t in enumerate(texts)]
    docs += [(100 + i, texts[i % 7], "src", None, None) for i in range(40)]
    docs += [(None, texts[0], "src", None, None), (None, None, "src", None, None), (3, texts[3], "weird", None, None), (3, texts[3], "weird", None, None), (3, "another text of this id", "weird", None, None), (-5, "cost $5", "src", None, None)]
    labels = [(i, i % 2, i % 3 % 2, 0) for i in range(0, 130, 2)] + [(3, None, 1, 0), (3, 1, None, 0), (None, 1, 1, 0), (100, 0, 0, 0), (9999, 1, 1, 1)]
    return docs, labels


def test_same_as_brute_force(spark):
    docs, labels = table()
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got, want = sorted(map(tuple, got.collect())), sorted(brute(docs, labels))
    assert len(got) == 3 * 600
    assert got == want


def test_same_as_sql(spark, tmp_path):
    docs, labels = table()
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(filter_audit.ORACLES["op13_filter_audit"])
    at = [[d[0] for d in want.description].index(c) for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
    assert sorted(map(tuple, filter_audit.op13_filter_audit(spark, str(tmp_path)).collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_empty_tables(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    alone = filter_audit.audit(spark.createDataFrame([(1, "x", None, None, None)], DOCS), spark.createDataFrame([], LABELS)).collect()
    assert len(alone) == 600 and sum(r["removed"] for r in alone) == 120 and all(r["shapley"] == (120 if r["filter_order"][r["step"] - 1] == "A" else 0) for r in alone)


def test_each_order_sums_up(spark):
    docs, labels = table()
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    per_order = got.groupBy("part", "filter_order").agg({"removed": "sum", "kept": "min"}).collect()
    assert {p: {r[2] + r[3] for r in per_order if r[0] == p} for p in {r[0] for r in per_order}} == {p: {sum((d[2] or "") == p for d in docs)} for p in ("", "src", "weird")}
