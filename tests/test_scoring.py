"""Outcomes of single fields: the taxonomy, each mode, and the rules for empty values."""

import json

import pytest
from pyspark.sql import functions as F

from docgauge.operators.scoring import FieldSpec, declared, score_cases

TEXT, FUZZY, DIGITS = FieldSpec("x"), FieldSpec("x", fuzzy_threshold=0.9), FieldSpec("x", "digits")
NUMBER, DATE, BOOL, SET = FieldSpec("x", "number", tolerance=0.01), FieldSpec("x", "date"), FieldSpec("x", "bool"), FieldSpec("x", "set_text")

CASES = [
    # spec, truth, predicted, outcome, score
    (TEXT, "a", None, "missing", 0.0),
    (TEXT, None, "a", "hallucinated", 0.0),
    (TEXT, None, "n/a", "correct", 1.0),
    (TEXT, "", " Ilegível ", "correct", 1.0),
    (TEXT, "João da Silva", "joao  DA silva.", "correct", 1.0),
    (TEXT, "Maria Souza", "Maria Sousa", "wrong", 1 - 1 / 11),
    (FUZZY, "Maria Souza", "Maria Sousa", "correct", 1 - 1 / 11),
    (TEXT, "...", "!!", "correct", 1.0),
    (FieldSpec("x", "exact"), "A", "a", "wrong", 0.0),
    (FieldSpec("x", "exact"), True, "True", "correct", 1.0),
    (DIGITS, "CRM 12.345/RS", "crm12345", "correct", 1.0),
    (DIGITS, "12345", "12346", "wrong", 0.8),
    (DIGITS, "no digits", "12", "malformed", 0.0),
    (DIGITS, "12", "illegible", "malformed", 0.0),
    (DIGITS, "12", "ilegivel", "missing", 0.0),
    (NUMBER, 1234.5, "R$ 1.234,50", "correct", 1.0),
    (NUMBER, "1,234.50", 1234.5, "correct", 1.0),
    (NUMBER, 10, "10,02", "wrong", 0.0),
    (NUMBER, 10, True, "malformed", 0.0),
    (NUMBER, 10, "ten", "malformed", 0.0),
    (DATE, "2026-03-04", "04/03/2026", "correct", 1.0),
    (DATE, "2026-03-04", "4 de março de 2026", "correct", 1.0),
    (DATE, "2026-03-04", "March 4th, 2026", "correct", 1.0),
    (DATE, "2026-03-04", "2026-03-04T10:00:00", "correct", 1.0),
    (DATE, "2026-04-13", "04/13/2026", "correct", 1.0),
    (DATE, "2026-03-04", "2026-13-40", "malformed", 0.0),
    (DATE, "2026-03-04", "2026", "malformed", 0.0),
    (DATE, "2026-03-04", "2026-03-05", "wrong", 0.0),
    (FieldSpec("x", "date", tolerance_days=1), "2026-03-04", "2026-03-05", "correct", 1.0),
    (FieldSpec("x", "date", dayfirst=False), "2026-04-03", "04/03/2026", "correct", 1.0),
    (BOOL, False, "não", "correct", 1.0),
    (BOOL, True, 1, "correct", 1.0),
    (BOOL, True, "rotina", "wrong", 0.0),
    (BOOL, True, "perhaps", "malformed", 0.0),
    (BOOL, False, None, "missing", 0.0),
    (SET, ["a", "b"], ["B", "A"], "correct", 1.0),
    (SET, ["a", "b"], "b; a", "correct", 1.0),
    (SET, ["a", "b"], ["a"], "wrong", 2 / 3),
    (SET, ["a"], ["x", "y"], "hallucinated", 0.0),
    (SET, ["a"], ["x"], "wrong", 0.0),
    (SET, ["a"], 5, "malformed", 0.0),
    (SET, 5, ["a"], "malformed", 0.0),
    (SET, [], ["a"], "hallucinated", 0.0),
    (FieldSpec("x", "no such mode"), "A", "a", "wrong", 0.0),  # as text, under no normalisers
]


def test_outcomes(spark):
    by_spec = {}
    for k, (spec, truth, predicted, outcome, score) in enumerate(CASES):
        by_spec.setdefault(spec, []).append((k, json.dumps({"x": truth}), json.dumps({"x": predicted})))
    found = {}
    for spec, rows in by_spec.items():
        df = spark.createDataFrame(rows, "k int, t string, p string").select("k", F.parse_json("t").alias("truth"), F.parse_json("p").alias("predicted"))
        found |= {r["k"]: (r["outcome"], r["score"]) for r in score_cases(df, [spec]).collect()}
    for k, (spec, truth, predicted, outcome, score) in enumerate(CASES):
        assert found[k][0] == outcome, (spec.compare, truth, predicted, found[k])
        assert found[k][1] == pytest.approx(score), (spec.compare, truth, predicted, found[k])


def test_refused_absent_and_extra_keys(spark):
    rows = [(1, '{"x": "a"}', None, "timeout"), (2, '{"x": "a"}', None, ""), (3, '{"x": "a"}', '{"y": 1}', ""), (4, '{"x": "a"}', '{"x": null}', ""), (5, '{"x": "a"}', '{"x": "A", "z": 1}', "")]
    df = spark.createDataFrame(rows, "k int, t string, p string, error string").select("k", "error", F.parse_json("t").alias("truth"), F.parse_json("p").alias("predicted"))
    got = {r["k"]: (r["outcome"], r["detail"]) for r in score_cases(df, [TEXT]).collect()}
    assert got == {1: ("refused", "timeout"), 2: ("refused", "no output"), 3: ("missing", "key absent from output"), 4: ("missing", "empty value returned"), 5: ("correct", "normalized match")}


def test_declarations():
    with pytest.raises(ValueError, match="unknown comparison"):
        declared([FieldSpec("a", "fuzzy")])
    with pytest.raises(ValueError, match="one name"):
        declared([FieldSpec("a"), FieldSpec("a")])
