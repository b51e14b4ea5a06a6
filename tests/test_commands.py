"""Commands that ask one question about one picture."""
from __future__ import annotations

import io
import json

from calibra import facade


def run(*argv):
    out = io.StringIO()
    code = facade.main(list(argv), out)
    return code, [json.loads(line) for line in out.getvalue().splitlines()]


def test_ask_answers_yes_or_no_and_choices(spark):
    code, rows = run("ask", "a.png", "There is a dog.")
    assert code == 0 and rows[0]["type"] == "noul" and rows[0]["answer"] in ("true", "false") and abs(sum(rows[0]["p"]) - 1) < 1e-9
    assert rows[0]["p"][1] == facade.Decider(spark).noul("a.png", "There is a dog.")
    code, rows = run("ask", "a.png", "What is shown?", "--option", "cat=a cat", "--option", "dog=a dog", "--option", "other")
    assert code == 0 and rows[0]["answer"] in ("cat", "dog", "other") and len(rows[0]["p"]) == 3 and 0 <= rows[0]["confidence"] <= 1


def test_score_takes_a_rubric_from_a_file_or_from_words(spark, tmp_path):
    levels = ["unusable", "poor", "fair", "good"]
    rubric = tmp_path / "rubric.json"
    rubric.write_text(json.dumps({"instructions": "How sharp is it?", "criteria": levels}))
    code, rows = run("score", "a.png", "--rubric", str(rubric))
    assert code == 0 and rows[0]["type"] == "score" and rows[0]["answer"] in levels
    assert rows == run("score", "a.png", "--instructions", "How sharp is it?", "--criteria", *levels)[1]


def test_score_without_criteria_is_refused(capsys, tmp_path):
    bare = tmp_path / "bare.json"
    bare.write_text("{}")
    assert run("score", "a.png") == (2, []) and run("score", "a.png", "--rubric", str(bare)) == (2, [])
    assert "--criteria" in capsys.readouterr().err
