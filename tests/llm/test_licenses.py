from __future__ import annotations

import re

import pytest

from calibra.llm import licenses

LINES = ["Released under the MIT License.", "Licensed### under*** the&&& Apache%%% License,!! Version 2.0.", "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3.", "She renewed her driving license.", "", "plain words", "Licensed under CC BY-NC 4.0.", "license", "the license of no one knows what under the sun license"]


def test_families():
    m = licenses.train()
    assert [m.predict(x)[0] for x in LINES[:4]] == ["MIT", "Apache-2.0", "GPL", "none"]
    assert m.predict(LINES[6])[0] == "CC-BY-NC"


def test_held_out_accuracy():
    m = licenses.train()
    rows = licenses._examples(seed=77)
    assert sum(m.predict(x)[0] == f for f, x in rows) / len(rows) > 0.93


def test_frame_form_is_the_same(spark):
    m = licenses.train()
    rows = [(1, "\n \n".join(LINES)), (2, None), (3, ""), (4, LINES[0]), (4, LINES[0]), (None, "x\n" * 2000 + LINES[1]), (5, "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\ndocumentation files, to deal in the Software without restriction"), (6, "This is free and unencumbered software released into the public domain.")]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, family string")
    scanned = licenses.scan(df)
    for r in scanned.collect():
        parts = re.split(licenses.PARAGRAPH, r["text"] or "")
        want = [(i, *m.predict(x)) for i, x in enumerate(parts)]
        want = [(i, f, round(p, 9)) for i, f, p in want if f != licenses.NONE and any(g in m.weights for g in licenses.grams(parts[i]))]
        assert [(x["paragraph"], x["family"], round(x["probability"], 9)) for x in r["licences"]] == want
    family = {r["doc_id"]: [x["family"] for x in r["licences"]] for r in scanned.collect()}
    assert family[5] == ["MIT"] and family[6] == ["CC0"]  # a wrapped notice; a dedication without the word licence
    assert not any(w in scanned._jdf.queryExecution().toString() for w in ("MapInArrow", "PythonUDF", "ArrowEvalPython"))
    assert licenses.scan(df.limit(0)).count() == 0


def test_every_feature_contains_a_needle():
    needles = licenses._needles()
    assert all(any(n in g for n in needles) for g in licenses.train().weights)


def test_a_column_of_the_same_name_is_an_error(spark):
    df = spark.createDataFrame([(1, "x", "mine")], "doc_id long, text string, Licences string")
    with pytest.raises(ValueError):
        licenses.scan(df)
