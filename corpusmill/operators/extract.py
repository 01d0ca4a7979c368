"""Graded evidence for tools and methods: mentions (N1), code and declarations (N2), CI runs of sustained projects (N3).

The catalog of tools is a short list that the protocol ships, so its patterns are compiled into expressions; items,
repositories and files stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import text as X

LEVELS = ("N1", "N2", "N3")


def mentions(items: DataFrame, catalog: list[dict], mode: str = "exact") -> DataFrame:
    """Rows (item_id, entry_id, confirmed_by, evidence): the first hit of each entry in title or body.

    An ambiguous entry needs one of its context words near the hit (`context`), else it stays `pending`. Entries are
    tried by one expression each; texts without any name are passed over by one joint pattern.
    """
    text = F.col("_text")

    def hit(entry: dict) -> Column:
        pattern = "|".join(X.term_pattern(n, mode) for n in entry["names"])

        def around(near: Column) -> Column:
            state = F.lit("name")
            if entry.get("ambiguous"):
                words = "|".join(X.term_pattern(w, mode) for w in entry.get("context", ())) or r"\b\B"
                state = F.when(near.rlike(words), "context").otherwise("pending")
            return F.struct(F.lit(entry["id"]).alias("entry_id"), state.alias("confirmed_by"), X.clip(near).alias("evidence"))

        def at(place: Column) -> Column:
            near = X.context(text, place, F.length(F.regexp_substr(text, F.lit(pattern))))
            return F.when(place > 0, X.let(near, around))

        return X.let(F.regexp_instr(text, F.lit(pattern)), at)

    items = items.withColumn("_text", F.concat_ws("\n", "title", "body"))
    found = [hit(entry) for entry in catalog]
    hits = F.filter(F.array(*found), lambda x: x.isNotNull())
    return items.select("item_id", "source", "repo", F.explode(hits).alias("h")).select("item_id", "source", "repo", "h.*")


def anchored(query: Column, tool: dict) -> Column:
    """Whether a search, in any case, was aimed at a tool; false for a null query.

    It names a repository or config file of the tool, imports one of its modules or a module of its id, asks for
    workflows with its token as a word, or for repositories by its id.
    """
    q = F.lower(query)
    names = lambda s: F.contains(q, F.lit(s.lower()))
    word = q.rlike(rf"(?<![\w-]){X.quoted((tool.get('token') or tool['id']).lower())}(?![\w-])")
    aims = [names("repo:") & names(tool["id"]), names("path:.github/workflows") & word]
    aims += [names(f"repo:{r}") for r in tool.get("repos", ())] + [names(f) for f in tool.get("configs", ())]
    for module in (*tool.get("imports", ()), tool["id"]):
        aims += [names(f"import {module}"), names(f"from {module} import")]
    return F.coalesce(F.array_contains(F.array(*aims), True), F.lit(False))


def code_hits(items: DataFrame, tools: list[dict]) -> DataFrame:
    """N2 rows (item_id, repo, entry_id, signal): items that a search for a tool's import or config file found."""
    base = F.substring_index("path", "/", -1)
    found = []
    for t in tools:
        imports = F.lit(False)
        for m in t.get("imports", ()):
            imports = imports | F.col("query").rlike(rf"(^|\W)(from\s+{X.quoted(m)}(\.\w+)*\s+import|import\s+{X.quoted(m)}\b)")
        config = base.isin(*t["configs"]) if t.get("configs") else F.lit(False)
        signal = F.when(imports, "import").when(config, "config")
        found.append(F.when(signal.isNotNull(), F.struct(F.lit(t["id"]).alias("entry_id"), signal.alias("signal"))))
    return items.where("kind = 'code'").select("item_id", "repo", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("h")).select("item_id", "repo", "h.*")


def sustained(signals: DataFrame) -> DataFrame:
    """Adds sustained: no error, commits in two months or more, two contributors or more."""
    return signals.withColumn("sustained", F.col("error").isNull() & (F.coalesce(F.size("commit_months"), F.lit(0)) >= 2) & (F.coalesce("contributors", F.lit(0)) >= 2))


def dependencies(declared: DataFrame, tools: list[dict]) -> DataFrame:
    """N2 rows (repo, entry_id, evidence) where a repository declares a tool's package; copies of the tool itself go."""
    packages = declared.sparkSession.createDataFrame([(t["id"], E.normal(p)) for t in tools for p in t["packages"]] or [("", "")], "entry_id string, package string")
    uses = declared.where("not own").join(F.broadcast(packages), F.col("name") == F.col("package")).groupBy("repo", "entry_id").agg(F.min_by("line", F.struct("path", "name")).alias("evidence"))
    base = F.regexp_replace(F.lower(F.substring_index("repo", "/", -1)), "[-_.]+", "-")
    names = declared.where("own").select("repo", "name").unionByName(declared.select("repo", base.alias("name"))).distinct()
    selves = names.join(F.broadcast(packages), F.col("name") == F.col("package")).select("repo", "entry_id").distinct()
    return uses.join(selves, ["repo", "entry_id"], "left_anti")


def ci_runs(executed: DataFrame, tools: list[dict]) -> DataFrame:
    """Rows (repo, path, entry_id, form, evidence): the strongest way in which each workflow invokes each tool."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, path, seq, kind, line, command, packages, repos in zip(*(batch.column(c).to_pylist() for c in ("repo", "path", "seq", "kind", "line", "command", "packages", "repos")), strict=True):
                for tool in tools if kind in ("run", "uses") else ():
                    form = E.ci_form(tool, kind, command, packages or [], repos or [])
                    if form is not None:
                        rows.append((repo, path, seq, tool["id"], form, f"{kind}: {line}"))
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["repo", "path", "seq", "entry_id", "form", "evidence"])

    hits = executed.mapInArrow(run, "repo string, path string, seq int, entry_id string, form int, evidence string")
    best = hits.groupBy("repo", "path", "entry_id").agg(F.min(F.struct("form", "seq", "evidence")).alias("b"))
    names = F.array(*map(F.lit, E.FORMS))
    return best.select("repo", "path", "entry_id", F.element_at(names, F.col("b.form") + 1).alias("form"), F.col("b.evidence").alias("evidence"))


def anchors(items: DataFrame) -> DataFrame:
    """Rows (repo, anchor_id): of each repository the first repository item, else the first code item."""
    rank = F.when(F.col("kind") == "repo", 0).when(F.col("kind") == "code", 1)
    return items.where(rank.isNotNull() & F.col("repo").isNotNull()).groupBy("repo").agg(F.min_by("item_id", F.struct(rank, F.col("seq"))).alias("anchor_id"))


def detections(items: DataFrame, files: DataFrame, signals: DataFrame, tools: list[dict], methods: list[dict] = ()) -> DataFrame:
    """All detections: item_id, repo, entry_id, entry_type, level, signal, evidence, confirmed_by.

    items: item_id, seq, source, kind, repo, title, body, query, path. files: repo, path, content. signals: repo, error,
    contributors, commit_months. Repositories with an error, or without a repository or code item, give nothing beyond
    mentions. A pending mention stays where a structural detection of the same tool and repository confirms it.
    """
    columns = ("item_id", "repo", "entry_id", "entry_type", "level", "signal", "evidence", "confirmed_by")

    def shaped(rows: DataFrame, **fixed: Column | str) -> DataFrame:
        return rows.withColumns({k: F.lit(v) if isinstance(v, str) else v for k, v in fixed.items()}).select(*columns)

    text = [shaped(mentions(items, [{"names": m["names"], **m} for m in kind], mode), entry_type=name, level="N1", signal="text") for name, kind, mode in (("tool", tools, "exact"), ("method", list(methods), "flexible")) if kind]
    none = F.lit("").alias("x")
    code = shaped(code_hits(items, tools), entry_type="tool", level="N2", evidence=F.col("signal"), confirmed_by=none)
    lasting = sustained(signals).where("error is null")
    home = lasting.join(anchors(items), "repo")
    manifests = files.where(~F.col("path").startswith(".github/workflows/"))
    declared = dependencies(E.declared(manifests), tools).join(home, "repo")
    declared = shaped(declared, item_id=F.col("anchor_id"), entry_type="tool", level="N2", signal="dependency", confirmed_by=none)
    own = items.where("path is not null").groupBy("repo", "path").agg(F.min_by("item_id", "seq").alias("own_id"))
    ci = ci_runs(E.executed(files.where(F.col("path").startswith(".github/workflows/"))), tools).join(home, "repo").join(own, ["repo", "path"], "left")
    level = F.when(F.col("sustained") & (F.col("form") != "name"), "N3").otherwise("N2")
    ci = shaped(ci, item_id=F.coalesce("own_id", "anchor_id"), entry_type="tool", level=level, signal="ci", confirmed_by=F.col("form"))
    structural = code.unionByName(declared).unionByName(ci)
    proof = structural.select("entry_id", "repo").distinct().withColumn("_proof", F.lit(True))
    out = structural
    for part in text:
        joined = part.join(proof, ["entry_id", "repo"], "left")
        kept = joined.where((F.col("confirmed_by") != "pending") | F.col("_proof"))
        out = out.unionByName(kept.withColumn("confirmed_by", F.when(F.col("confirmed_by") == "pending", "structural").otherwise(F.col("confirmed_by"))).select(*columns))
    return out


def selected_workflows(tree: DataFrame, most_hits: int = 20, most: int = 10) -> DataFrame:
    """Of each repository's workflow paths (repo, path, is_hit): the hits first, up to most_hits, others up to `most` in all."""
    w = Window.partitionBy("repo").orderBy(F.desc("is_hit"), "path")
    hits = F.sum(F.col("is_hit").cast("int")).over(Window.partitionBy("repo"))
    marked = tree.withColumn("_n", F.row_number().over(w)).withColumn("_h", F.least(hits, F.lit(most_hits)))
    return marked.where(F.when(F.col("is_hit"), F.col("_n") <= most_hits).otherwise(F.col("_n") <= F.greatest(F.lit(most), F.col("_h")))).drop("_n", "_h")


def tree_signals(tree: DataFrame) -> DataFrame:
    """By repository (repo, path rows): whether it has tests and CI, its test paths (50 at most) and manifests (6 at most)."""
    p = F.col("path")
    manifest = p.rlike(r"^(requirements[^/]*\.txt|pyproject\.toml|setup\.(py|cfg)|package\.json|Cargo\.toml|go\.mod)$")
    some = lambda c, n: F.slice(F.array_sort(F.collect_set(F.when(c, p))), 1, n)
    return tree.groupBy("repo").agg(F.max(X.is_test_path(p)).alias("has_tests"), F.max(p.startswith(".github/workflows/")).alias("has_ci"), some(X.is_test_path(p), 50).alias("test_paths"), some(manifest, 6).alias("manifests"))


def reusable(wanted: DataFrame, earlier: DataFrame, today: str, days: int) -> DataFrame:
    """For each wanted repo and key the newest error-free earlier signal of at most so many days."""
    fresh = earlier.where(F.col("error").isNull() & (F.datediff(F.lit(today).cast("date"), F.to_date("fetched_at")) <= days))
    rest = [c for c in earlier.columns if c not in ("repo", "key")]
    return wanted.join(fresh, ["repo", "key"]).groupBy("repo", "key").agg(F.max_by(F.struct(*rest), "fetched_at").alias("s")).select("repo", "key", "s.*")


def applied(items: DataFrame, signals: DataFrame) -> DataFrame:
    """Items with their repository's error-free signals in the columns has_ci, has_tests, contributors, active_months."""
    s = signals.where("error is null").select("repo", F.col("has_ci").alias("_ci"), F.col("has_tests").alias("_tests"), F.col("contributors").alias("_people"), F.size("commit_months").alias("_months"))
    names = {"has_ci": "_ci", "has_tests": "_tests", "contributors": "_people", "active_months": "_months"}
    return items.join(s, "repo", "left").withColumns({k: F.coalesce(v, F.col(k)) if k in items.columns else F.col(v) for k, v in names.items()}).drop(*names.values())
