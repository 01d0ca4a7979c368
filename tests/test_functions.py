"""Scalar functions, parsers and operators on hand-made cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import evidence as E
from corpusmill.functions import html
from corpusmill.functions import text as X
from corpusmill.operators import analysis as A
from corpusmill.operators import dedupe as D
from corpusmill.operators import design as W
from corpusmill.operators import extract as G
from corpusmill.operators import stats as S
from corpusmill.operators import topics as M
from corpusmill.sources import connectors as C
from corpusmill.streaming import accumulate as T

URLS = [
    ("HTTP://WWW.Example.com:80/a/?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2"),
    ("https://example.com", "https://example.com/"),
    ("https://GitHub.com/Owner/Repo.git", "https://github.com/owner/repo"),
    ("https://huggingface.co/datasets/Own/Set", "https://huggingface.co/datasets/own/set"),
    ("https://x.org/p?q=&ref=z&q=2", "https://x.org/p?q=&q=2"),
    ("https://x.org:8443/p;v=1?k=a%20b", "https://x.org:8443/p?k=a+b"),
]


def test_canonical_urls(spark):
    rows = spark.createDataFrame(URLS, "url string, expected string").select("url", "expected", X.canonical_url(F.col("url")).alias("got")).collect()
    assert [r.got for r in rows] == [r.expected for r in rows]


def test_stem_and_patterns(spark):
    words = spark.createDataFrame([("testings",), ("evaluation",), ("used",), ("rags",)], "w string")
    assert [r[0] for r in words.select(X.stem("w")).collect()] == ["test", "evalu", "used", "rags"]
    text = spark.createDataFrame([("Testing the test-suites of a tester; contest",)], "t string")
    assert text.select(F.regexp_count("t", F.lit(X.term_pattern("tests")))).first()[0] == 3
    assert text.select(F.regexp_count("t", F.lit(X.term_pattern("test", "exact")))).first()[0] == 1
    assert text.select(X.context(F.col("t"), F.lit(13), F.lit(4), 1)).first()[0].startswith("the test")


def test_content_hash_and_clip(spark):
    row = spark.createDataFrame([("", " a\n b "), (None, "a b")], "t string, b string").select(X.content_hash(F.col("t"), F.col("b"))).collect()
    assert row[0][0] == row[1][0]
    assert len(spark.range(1).select(X.clip(F.lit("x" * 400))).first()[0]) == 300


def test_manifests():
    found, own = E.manifest("pyproject.toml", '[project]\nname = "My.App"\ndependencies = ["Ragas[all]>=0.2"]\n[project.optional-dependencies]\ndev = ["pytest"]\n[tool.poetry.dependencies]\npython = "^3"\nfoo = {version = "1"}\n')
    assert set(found) == {"ragas", "pytest", "foo"} and own == {"my-app"}
    assert set(E.manifest("package.json", '{"name": "x", "devDependencies": {"a_b": "1"}}')[0]) == {"a-b"}
    assert E.manifest("package.json", "{oops") == ({}, set())
    assert set(E.manifest("setup.py", "setup(name='n', install_requires=['ir-measures[x]', 'b>1'], extras_require={'dev': ['c']})")[0]) == {"ir-measures", "b", "c"}
    assert set(E.manifest("requirements.txt", "# c\nragas==1 ; x\n-r other\n")[0]) == {"ragas"}
    assert "github-com/a/b" in E.manifest("go.mod", "require github.com/a/b v1.2\n")[0]
    assert set(E.manifest("setup.cfg", "[metadata]\nname = q\n[options]\ninstall_requires =\n  z>=1\n")[0]) == {"z"}


WORKFLOW = """
on: push
jobs:
  t:
    uses: own/flows/.github/workflows/x.yml@v1
    steps:
      - name: ragas is named
        run: |
          # comment
          echo ragas
          pip install -U "ragas>=0.2" -r req.txt && \\
            pytest -m "not slow"
      - uses: actions/checkout@v4
"""


def test_workflows():
    assert E.steps(WORKFLOW)[0] == ("uses", "own/flows/.github/workflows/x.yml@v1")
    assert E.steps("a: [") is None
    lines = list(E.lines_of(E.steps(WORKFLOW)))
    assert E.command_text("echo ragas").strip() == "" and ("run", "echo ragas") in lines
    assert ("ragas", None) in E.installed(E.command_text(lines[2][1]))
    assert E.installed("uv run --with promptfoo x") == [("promptfoo", None)]
    assert E.installed("pip install git+https://github.com/Own/Tool.git@main")[0][1] == "own/tool"


def test_outline_without_yaml(monkeypatch):
    monkeypatch.setattr(E, "yaml", None)
    assert ("uses", "actions/checkout@v4") in E.steps(WORKFLOW)
    assert any("pip install" in t for k, t in E.steps(WORKFLOW) if k == "run")


TOOL = {"id": "ragas", "token": "ragas", "names": ["ragas"], "cli": ["ragas eval"], "imports": ["ragas"], "packages": ["ragas"], "repos": ["own/ragas"], "configs": ["ragas.yaml"], "ambiguous": False, "anchor": True}


@pytest.mark.parametrize(("kind", "command", "form"), [("uses", "own/ragas@v1", 0), ("uses", "own/ragas-action@v1", 0), ("uses", "else/ragas@v1", 4), ("uses", "else/ragas-run@v1", None), ("run", "FOO=1 uv run ragas eval x", 1), ("run", "python -m ragas", 2), ("run", "cat ragas.txt", 4), ("run", "pytest", None)])
def test_ci_forms(kind, command, form):
    assert E.ci_form(TOOL, kind, command, [], []) == form


def test_ci_install_form():
    assert E.ci_form(TOOL, "run", "pip install x", ["ragas"], []) == 3


def test_html():
    assert html.parsed("<title>T &amp; U</title><nav>no<div>no</div></nav><p>One  two</p><div>three<script>x()</script></div>") == ("T & U", "One two\nthree")


def test_detections(spark):
    items = spark.createDataFrame([("i1", 1, "github", "repo", "o/r", "about ragas", None, "q", None), ("i2", 2, "github", "code", "o/r", None, "x", "import ragas", ".github/workflows/ci.yml"), ("i3", 3, "hn", "thread", None, None, "nothing", None, None)], "item_id string, seq long, source string, kind string, repo string, title string, body string, query string, path string")
    files = spark.createDataFrame([("o/r", "requirements.txt", "ragas\n"), ("o/r", ".github/workflows/ci.yml", "jobs:\n  t:\n    steps:\n      - run: ragas eval all\n")], "repo string, path string, content string")
    signals = spark.createDataFrame([("o/r", None, 3, ["2024-01", "2024-02"])], "repo string, error string, contributors int, commit_months array<string>")
    got = {(r.item_id, r.level, r.signal) for r in G.detections(items, files, signals, [TOOL]).collect()}
    assert got == {("i1", "N1", "text"), ("i2", "N2", "import"), ("i1", "N2", "dependency"), ("i2", "N3", "ci")}


def test_exact_passes(spark):
    rows = spark.createDataFrame([(1, "u1", "c1", "b", "article"), (2, "u1", "c2", "b", "article"), (3, "u2", "c1", "b", "article"), (4, "u3", "c1", " ", "article"), (5, "u4", "c1", "b", "code")], "seq long, canonical_url string, content_key string, body string, kind string")
    assert {r.seq: r.reason for r in D.exact_passes(rows).collect()} == {1: None, 2: "url", 3: "content", 4: None, 5: None}


def test_greedy_keep(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "k long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    assert {r.k: r.kept for r in D.greedy_keep(nodes, pairs, "k").collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_greedy_keep_leaves_nothing_undecided(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "k long")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(7)], "a long, b long")
    assert {r.k: r.kept for r in D.greedy_keep(nodes, pairs, "k").collect()} == {i: i % 2 == 0 for i in range(8)}
    with pytest.raises(RuntimeError, match="undecided"):
        D.greedy_keep(nodes, pairs, "k", rounds=2)


def test_near_keep_drops_copies_of_a_dropped_text(spark, tmp_path):
    import re

    from corpusmill.plans.items import near_dup_keep

    base = [f"w{i}" for i in range(60)]
    edited = [*base[:57], "x", "y", "z"]
    texts = [base, edited, edited, [*edited[:52], "p", "q", *edited[54:]], base, edited, ["short"], ["short"], [f"v{i}" for i in range(40)], None]
    rows = [(i, " ".join(t) if t else None) for i, t in enumerate(texts)]
    shingles = {}
    for i, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        if len(w) >= D.MIN_TOKENS:
            shingles[i] = {" ".join(w[k : k + D.SHINGLE]) for k in range(len(w) - D.SHINGLE + 1)}
    kept: list[int] = []
    for i, _ in rows:
        if i not in shingles or not any(j in shingles and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) for j in kept):
            kept.append(i)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = near_dup_keep(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(i, i in kept) for i, _ in rows]
    assert not {1, 2, 4, 5} & set(kept)


def test_near_pairs_of_edited_text(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:59], "other"])), (3, "short text"), (4, " ".join(base)), (5, None)]
    got = {(r.a, r.b) for r in D.near_pairs(spark.createDataFrame(rows, "k long, t string"), key="k", text="t").collect()}
    assert got == {(1, 2), (1, 4)}


def test_ranked_batches(spark):
    rows = spark.createDataFrame([(i, float(i % 3)) for i in range(50)], "k long, s double")
    got = D.ranked(rows, [F.desc("s"), F.asc("k")], 7).orderBy("rank").collect()
    assert [r.k for r in got] == [k for k, _ in sorted(((i, float(i % 3)) for i in range(50)), key=lambda x: (-x[1], x[0]))]
    assert [r.batch for r in got] == [i // 7 + 1 for i in range(50)]


def test_binomial_wilson_kappa(spark):
    assert A.binomial_greater(9, 10) == pytest.approx(11 / 1024)
    rows = [(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15
    assert S.kappa(spark.createDataFrame(rows, "a int, b int"), "a", "b").first().kappa == pytest.approx(0.4)
    assert S.kappa(spark.createDataFrame([(1, 1)] * 3, "a int, b int"), "a", "b").first().kappa is None
    assert S.p_value(spark, "chi2", 39.477, 17) == pytest.approx(0.0015329, rel=1e-3)
    assert spark.range(1).select(S.two_sided(F.lit(1.96))).first()[0] == pytest.approx(0.05, abs=1e-3)


def test_midranks_and_holm(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 2), ("b", 5)], "s string, v int")
    assert sorted(r.percentile for r in S.with_midranks(rows, "v", ["s"]).collect()) == [0.0, 0.5, pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(2 / 3)]
    got = S.holm(spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "n string, p double"), "p", ["n"]).orderBy("p").collect()
    assert [r.p_holm for r in got] == pytest.approx([0.03, 0.06, 0.06])


def test_strata_and_allocation(spark):
    q = spark.createDataFrame([(100, 0, 4000, True), (100, 900, 5000, True), (100, 0, None, True), (100, 0, 80, True), (10, 0, 100, False)], "items long, discarded long, available long, cut_short boolean")
    assert [r.weight for r in W.strata(q).collect()] == [40.0, 5.0, 1.0, 1.0, 1.0]
    sizes = spark.createDataFrame([("a", 900), ("b", 100)], "stratum string, size long")
    assert {r.stratum: r.allocated for r in W.allocation(sizes, 10).collect()} == {"a": 8, "b": 2}
    assert {r.stratum: r.allocated for r in W.allocation(sizes, 1).collect()} == {"a": 1, "b": 0}
    assert {r.stratum: r.allocated for r in W.allocation(sizes, 5000).collect()} == {"a": 900, "b": 100}


def test_year_split_and_halves(spark):
    w = spark.createDataFrame([(dt.date(2023, 6, 1), dt.date(2024, 2, 1))], "since date, until date")
    assert [(r.from_day, r.to_day) for r in W.split_by_year(w).collect()] == [(dt.date(2023, 6, 1), dt.date(2023, 12, 31)), (dt.date(2024, 1, 1), dt.date(2024, 2, 1))]
    a, b = W.halves(w).orderBy("half").collect()
    assert (b.from_day - a.to_day).days == 1


def test_ols(spark):
    rows = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(20)], "x double, y double")
    fitted = S.ols(rows, "y", ["x"])
    assert fitted["x"][0] == pytest.approx(2) and fitted["intercept"][0] == pytest.approx(1)


def test_sheets_and_sinks(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text('﻿id;note\n1;"two\nlines"\n', encoding="utf-8")
    row = C.scan_sheet(spark, str(path)).first()
    assert row["id"] == "1" and row["note"] == "two\nlines"
    assert spark.range(1).select(C.cell_lists(F.lit("a, b;a|c"))).first()[0] == ["a", "b", "c"]
    lines = tmp_path / "raw.jsonl"
    lines.write_text('{"source":"rss","native_id":"1","payload":{"id":"a\u2028b"},"fetched_at":"2024-01-01T00:00:00Z"}\n', encoding="utf-8")
    assert C.scan_raw(spark, str(lines)).count() == 1
    C.write_csv(spark.createDataFrame([({"b": 2, "a": 1}, ["x"], None)], "m map<string,int>, l array<string>, n string"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep=";", header=True).first()["m"] == "a=1; b=2"


def test_corrupt_items_are_counted(spark, tmp_path):
    from pyspark.sql import types as Ty

    path = tmp_path / "items.jsonl"
    path.write_text('{"id":"1"}\nnot json\n', encoding="utf-8")
    good, bad = C.scan_items(spark, str(path), Ty.StructType([Ty.StructField("id", Ty.StringType())]))
    assert good.count() == 1 and bad.count() == 1


def test_token_bucket(spark):
    rows = spark.createDataFrame([("s", i, 0.0) for i in range(4)], "source string, n int, asked_at double")
    assert [r.starts_at for r in C.running_quota(rows, 1.0, 2, 3).orderBy("n").collect()] == [0.0, 0.0, 1.0, 2.0]


def test_daily_quota_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s", "d", i) for i in range(5)], "source string, day string, request long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = T.daily_quota(T.file_stream(spark, str(tmp_path / "in"), rows.schema), 3).writeStream.format("memory").queryName("quota").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    T.drained(query)
    assert spark.table("quota").where("allowed").count() == 3


def test_topics(spark):
    docs = spark.createDataFrame([(i, ("alpha beta gamma delta " if i % 2 else "red green blue black ") * 5) for i in range(8)], "k long, t string")
    by = {r.k: r.cluster for r in M.clusters(docs, "k", "t", 2).collect()}
    assert len({by[i] for i in (1, 3, 5, 7)}) == 1 and by[0] != by[1]
    assert M.topics(docs, "t", 2, 3).count() == 2


def test_workflow_selection_and_tree(spark):
    tree = spark.createDataFrame([("r", f".github/workflows/{i:02d}.yml", i < 3) for i in range(15)], "repo string, path string, is_hit boolean")
    assert G.selected_workflows(tree).count() == 10
    signals = G.tree_signals(spark.createDataFrame([("r", "tests/test_a.py"), ("r", "pyproject.toml"), ("r", "src/a.py")], "repo string, path string")).first()
    assert signals.has_tests and not signals.has_ci and signals.manifests == ["pyproject.toml"]
