from __future__ import annotations


def test_entry_without_corpus_operators():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "dual_encoder_choice" in q


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["n", "accuracy", "ece"]
    assert e.entry(spark).first()["n"] > 0
