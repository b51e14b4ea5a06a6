"""The registered queries on the smallest tables: their columns, and the same rows as their SQL."""
from __future__ import annotations

import duckdb
import pytest

from calibra.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op2_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score", "rejected"],
    "op7_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"],
    "op9_ngram_jaccard": ["doc_id", "n_shingles", "component_id", "n_links"],
    "op10_exact_top_k": ["query_id", "rank", "vec_id", "score"],
    "op11_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op12_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op13_filter_audit": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns)
    got = sorted(map(tuple, df.collect()), key=repr)
    if name.startswith("op10"):
        assert len(got) == 5 * spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 50 = 0").count()
    elif name.startswith("op13"):
        assert len(got) == 600 * spark.read.parquet(f"{SF}/documents.parquet").select("source").distinct().count()
    else:
        assert len(got) == spark.read.parquet(f"{SF}/{'pages' if name.startswith('op11') else 'documents'}.parquet").count()
    if name in registry.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "labels", "pages"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.execute(registry.ORACLES[name])
        at = [[d[0] for d in want.description].index(c) for c in df.columns]
        assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_held_out_accuracy(spark):
    r = registry.QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    assert r.filter("lang = lang_pred").count() / r.count() > 0.97
