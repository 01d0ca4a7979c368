"""Stores of runs in both layouts, units, labels and retries, case by case."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import requests as Q
from corpusmill.operators import extract as G
from corpusmill.operators import units as U
from corpusmill.sources import runs as S

ITEM = "id string, seq bigint, kind string, url string, title string, body string"


def line(i, seq, body="x", url=None, **more):
    return json.dumps({"id": i, "seq": seq, "kind": "article", "url": url or f"https://a.org/{i}", "body": body, **more})


@pytest.fixture
def root(tmp_path):
    for run, kind, lines in (
        ("r2", "items", [line("a", 1, "of r2"), line("c", 2)]),
        ("r1", "items", ["﻿" + line("a", 1, "of r1"), "", line("b", 2, "same"), line("b", 3, "again")]),
        ("r1", "items_deduped", [line("a", 1, "deduped")]),
        ("r3", "items_deduped", [line("d", 1, "same")]),
    ):
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / f"{kind}.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(tmp_path)


def ids(frame):
    return sorted((r.run, r.id, r.body) for r in frame.collect())


def test_runs_and_kinds(spark, root):
    held = S.catalog(spark, root)
    assert sorted((r.run, r.kind) for r in held.collect()) == [("r1", "items"), ("r1", "items_deduped"), ("r2", "items"), ("r3", "items_deduped")]
    assert sorted(r.run for r in S.runs(held).collect()) == ["r1", "r2", "r3"]


def test_preferred_file_else_the_other(spark, root):
    assert ids(S.read_items(spark, root, "r1", ITEM, prefer_deduped=True)) == [("r1", "a", "deduped")]
    assert ids(S.read_items(spark, root, "r1", ITEM)) == [("r1", "a", "of r1"), ("r1", "b", "again"), ("r1", "b", "same")]
    assert ids(S.read_items(spark, root, "r3", ITEM)) == [("r3", "d", "same")]
    assert ids(S.read_items(spark, f"file://{root}/", "r9", ITEM)) == []


def test_consolidated_is_the_union_or_its_own_file(spark, root, tmp_path):
    assert ids(S.read_items(spark, root, "consolidated", ITEM)) == [("r1", "a", "of r1"), ("r1", "b", "same"), ("r2", "c", "x"), ("r3", "d", "same")]
    assert ids(S.read_items(spark, root, "consolidated", ITEM, prefer_deduped=True)) == [("r1", "a", "deduped"), ("r2", "c", "x"), ("r3", "d", "same")]
    (tmp_path / "consolidated").mkdir()
    with gzip.open(tmp_path / "consolidated" / "items.jsonl.gz", "wt") as f:
        f.write(line("z", 1))
    assert ids(S.read_items(spark, root, "consolidated", ITEM)) == [("consolidated", "z", "x")]
    assert sorted(r.run for r in S.runs(S.catalog(spark, root), with_consolidated=True).collect())[0] == "consolidated"


def test_detections_of_all_runs(spark, tmp_path):
    schema = "item_id string, entry_id string, signal string, location string, level string, seq bigint"
    row = lambda level, seq, where="l": json.dumps({"item_id": "i", "entry_id": "e", "signal": "ci", "location": where, "level": level, "seq": seq})
    for run, lines in (("consolidated", [row("N3", 1), row("N3", 2, "m")]), ("r1", [row("N1", 2), row("N2", 3)]), ("r2", [row("N2", 1)])):
        (tmp_path / run).mkdir()
        (tmp_path / run / "detections.jsonl").write_text("\n".join(lines))
    made = S.read_detections(spark, str(tmp_path), "consolidated", schema)
    assert sorted((r.run, r.level, r.location) for r in made.collect()) == [("consolidated", "N3", "m"), ("r1", "N1", "l")]
    assert S.read_detections(spark, str(tmp_path), "r1", schema).count() == 2


def test_a_line_that_does_not_parse_is_an_error(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "items.jsonl").write_text('{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        S.read_items(spark, str(tmp_path), "r1", ITEM).collect()


@pytest.mark.parametrize(
    ("query", "aimed"),
    [
        ("REPO:Acme/Brand x", True), ("Import brandlib", True), ("from Brand.id import", True), ("path:.github/workflows brand-cli", True),
        ("path:.github/workflows my-brand-cli", False), ("brand-cli", False), ("a brand.YAML b", True), ("repo:x/y brand.id", True), ("brand.id", False), ("", False), (None, False),
    ],
)
def test_anchored(spark, query, aimed):
    tool = {"id": "brand.id", "token": "brand-cli", "repos": ["acme/brand"], "configs": ["brand.yaml"], "imports": ["brandlib"]}
    row = spark.createDataFrame([(query,)], "q string").select(G.anchored(F.col("q"), tool).alias("a")).first()
    assert row.a is aimed


def test_units_fall_back_to_the_repository(spark):
    items = spark.createDataFrame([("i1", 1, "o/r", "import t"), ("i2", 2, None, None), ("i2", 3, "o/s", "q")], "item_id string, seq long, repo string, query string")
    found = spark.createDataFrame([("i1", None, "t", "tool"), ("x", "o/r", "t", "tool"), ("x", "o/none", "t", "tool"), (None, None, "t", "tool"), ("i2", "o/r", "m", "method")], "item_id string, repo string, entry_id string, entry_type string")
    made = U.detection_units(items, found, [{"id": "t"}]).select("item_id", "unit_id", "channel").collect()
    assert sorted(map(tuple, made)) == [("i1", "o/r", "anchored"), ("i2", "o/s", None), ("x", "o/r", "open")]
    assert U.detection_units(items, found.limit(0), []).count() == 0


def test_labels_in_any_case(spark):
    rows = spark.createDataFrame([(1, ["Bug", "Stale"]), (2, ["ok"]), (3, None), (4, []), (5, [None])], "i int, labels array<string>")
    assert [r.i for r in U.without_labels(rows, ["STALE"]).orderBy("i").collect()] == [2, 3, 4, 5]
    assert U.without_labels(rows, []).count() == 5


def test_seeded_order_hangs_on_the_seed_alone(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    order = lambda seed, frame: [r.k for r in U.seeded_order(frame, "k", seed, 100).orderBy("rank").collect()]
    assert order(1, rows) == order(1, rows.repartition(7)) != order(2, rows)
    made = U.seeded_order(rows, "k", 1, 100)
    assert sorted(r.rank for r in made.collect()) == list(range(1, 501))
    assert {r["count"] for r in made.groupBy("batch").count().collect()} == {100}


@pytest.mark.parametrize(
    ("status", "attempt", "after", "remaining", "reset", "wait"),
    [
        (429, 0, None, None, None, 5.0), (403, 3, None, None, None, 40.0), (429, 4, None, None, None, 60.0), (429, 5, None, None, None, None), (500, 0, None, None, None, None),
        (429, 0, 7.0, None, None, 7.0), (429, 0, 7.0, 3, 1100.0, 8.5), (403, 0, None, 0, 1100.0, 101.5), (403, 0, 2.0, 0, 1100.0, 103.5), (403, 1, None, 0, 900.0, 10.0), (403, 0, None, 0, 5000.0, None), (None, 0, None, None, None, None),
    ],
)
def test_retry_wait(spark, status, attempt, after, remaining, reset, wait):
    row = spark.createDataFrame([(status, attempt, 1000.0, after, remaining, reset)], "s int, a int, n double, f double, m int, r double")
    assert row.select(Q.retry_wait(*map(F.col, "sanfmr")).alias("w")).first().w == wait


def test_paths_only(spark):
    rows = spark.createDataFrame([('{"w": {"b": "x", "a": {"c": 1}}}',), ("{}",), (None,)], "r string")
    assert [r.p for r in rows.select(Q.paths_only(F.col("r"), "w").alias("p")).collect()] == [["a", "b"], [], []]
