"""Protocols, sheets and reports on hand-made cases."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import coding as K
from corpusmill.sources import protocol as P
from corpusmill.sources import render as V


def test_protocol(spark):
    text = "﻿" + '{"window": {"since": "2025-01-01", "until": "2024-01-01"}, "terms": ["a", "b"], "languages": {"zz": "en"}, "sources": [{"name": "x", "raw": ["q"], "kinds": ["repo", "code"], "concept_queries": ["rag"]}], "coding": {"fields": [{"name": "coder"}, {"name": "f", "vocabulary": "tools"}, {"name": "f"}]}}'
    made = P.load(text)
    assert len(P.problems(made)) == 6
    env = P.parse_env("# c\nexport SINCE='2023-01-01'\nTERMS=a , c # x\nBAD LINE\n")
    assert env == {"SINCE": "2023-01-01", "TERMS": "a , c"}
    changed = P.overridden(made, env)
    assert changed["terms"] == ["a", "c"] and P.problems(changed) != P.problems(made)
    rows = P.planned(spark, made).orderBy("seq").collect()
    assert [r["literal"] for r in rows] == [True, False, False, False, False]


def test_catalog(spark):
    entry = {"id": "a", "names": ["One", "two"]}
    assert P.tools(spark, {"tools": [entry]}).count() == 1
    with pytest.raises(ValueError, match="one"):
        P.tools(spark, {"tools": [entry, {"id": "b", "names": ["one"]}]})


def test_split_to_cap():
    days = lambda a, b: (b - a).days + 1
    parts = P.split_to_cap(date(2024, 1, 1), date(2024, 1, 10), days, 3)
    assert sum(days(a, b) for a, b, _ in parts) == 10 and all(days(a, b) <= 3 for a, b, _ in parts)
    assert P.split_to_cap(date(2024, 1, 1), date(2024, 1, 1), lambda a, b: 9, 3) == [(date(2024, 1, 1), date(2024, 1, 1), True)]


def test_cells(spark):
    row = spark.range(1)
    values, bad = K.allowed_values(F.lit("Avaliação; teste, X"), ["avaliacao", "Teste"], True)
    assert row.select(values, bad).first() == (["avaliacao", "Teste"], ["X"])
    assert row.select(K.decision(F.lit(" Não ")), K.decision(F.lit("?")), K.decision(F.lit("abc"))).first() == ("exclude", "uncertain", None)
    assert row.select(K.truth(F.lit("Sim")), K.truth(F.lit("0")), K.truth(F.lit("so"))).first() == (True, False, None)
    assert row.select(K.valid_coder(F.lit("ana")), K.valid_coder(F.lit("final")), K.valid_coder(F.lit("ção"))).first() == (True, False, False)


def test_reports(spark):
    assert V.number(1234567.5, 1) == "1.234.567,5" and V.latex("a_b%") == r"a\_b\%"
    for kind in ("mermaid", "tikz", "list"):
        assert "kept" in V.flow_chart([("found", 3), ("kept", 2)], kind)
    frame = spark.createDataFrame([("a", 1)], "n string, v int")
    assert "| a | 1 |" in V.markdown_table(frame) and r"a & 1" in V.latex_table(frame)
    assert V.macros({"n1eff": 2}) == r"\newcommand{\neff}{2}"
    zipped = V.package({"d/items.jsonl": '{"a": 1}\nbad\n'})
    assert zipped == V.package({"d/items.jsonl": '{"a": 1}\nbad\n'}) and V.opened(zipped, "items.jsonl") == ([{"a": 1}], 1)
