"""Protocols, catalogs and environment files: read on the driver, checked, and turned into small tables."""

from __future__ import annotations

import json
import re
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:
    yaml = None

TOOL_SCHEMA = "id string, token string, family string, names array<string>, cli array<string>, imports array<string>, packages array<string>, repos array<string>, configs array<string>, context array<string>, ambiguous boolean, anchor boolean"
RESERVED = ("item_id", "coder", "url", "title", "rank")


def load(text: str) -> dict:
    """A protocol or catalog from YAML or JSON text, with or without a byte order mark."""
    text = text.lstrip("﻿")
    made = yaml.safe_load(text) if yaml else json.loads(text)
    if not isinstance(made, dict):
        raise ValueError("a protocol is a mapping")
    return made


def tools(spark: SparkSession, catalog: dict) -> DataFrame:
    """The catalog's tools, a row each; aliases and ids must be unique."""
    rows = []
    for t in catalog.get("tools", []):
        lists = {k: list(t.get(k) or []) for k in ("names", "cli", "imports", "packages", "repos", "configs", "context")}
        rows.append((t["id"], t.get("token", t["id"]), t.get("family", ""), *(lists[k] for k in ("names", "cli", "imports", "packages", "repos", "configs", "context")), bool(t.get("ambiguous")), bool(t.get("anchor"))))
    made = spark.createDataFrame(rows, TOOL_SCHEMA)
    twice = shared_aliases(made).limit(5).collect()
    if twice:
        raise ValueError(f"aliases of several entries: {', '.join(r.alias for r in twice)}")
    return made


def shared_aliases(made: DataFrame) -> DataFrame:
    """Aliases that more than one entry has, without regard to case."""
    return made.select("id", F.explode("names").alias("n")).groupBy(F.lower("n").alias("alias")).agg(F.count_distinct("id").alias("entries")).where("entries > 1")


def problems(protocol: dict) -> list[str]:
    """What is wrong with a protocol: window order, literal queries without support, fields, concepts, languages."""
    found = []
    window = protocol.get("window") or {}
    since, until = str(window.get("since", "")), str(window.get("until", ""))
    if since and until and since > until:
        found.append("the window ends before it begins")
    concepts = set(protocol.get("concepts") or {})
    names: list[str] = []
    for field in (protocol.get("coding") or {}).get("fields", []):
        names.append(field.get("name", ""))
        if field.get("vocabulary") and not protocol.get("gazetteer"):
            found.append(f"field {field.get('name')} needs a gazetteer")
        if field.get("name") in RESERVED:
            found.append(f"field name {field.get('name')} is reserved")
    found += [f"field {n} occurs twice" for n in sorted({n for n in names if names.count(n) > 1})]
    for source in protocol.get("sources") or []:
        if source.get("raw") and not source.get("literal", True):
            found.append(f"source {source.get('name')} takes no literal queries")
        found += [f"concept {c} isn't defined" for c in source.get("concept_queries", []) if c not in concepts]
    terms = {t.lower() for t in protocol.get("terms") or []}
    found += [f"language of an unknown term: {t}" for t in (protocol.get("languages") or {}) if t.lower() not in terms]
    return found


def parse_env(text: str) -> dict[str, str]:
    """KEY=VALUE lines; comments and `export` are passed over, quotes dropped."""
    out = {}
    for line in text.splitlines():
        if m := re.match(r"""\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^#\n]*?))\s*(?:#.*)?$""", line):
            out[m[1]] = next(g for g in m.groups()[1:] if g is not None)
    return out


def overridden(protocol: dict, env: dict[str, str]) -> dict:
    """A protocol with the window, terms and sources that the environment sets; all else stays."""
    out = dict(protocol)
    window = dict(out.get("window") or {})
    for key, name in (("since", "SINCE"), ("until", "UNTIL")):
        if env.get(name):
            window[key] = env[name]
    if window:
        out["window"] = window
    if env.get("TERMS"):
        out["terms"] = [t.strip() for t in env["TERMS"].split(",") if t.strip()]
    if env.get("SOURCES"):
        wanted = {s.strip() for s in env["SOURCES"].split(",")}
        out["sources"] = [s for s in out.get("sources") or [] if s.get("name") in wanted]
    return out


def planned(spark: SparkSession, protocol: dict) -> DataFrame:
    """The queries of a protocol: literal ones first, then each term for each kind of each source."""
    window = protocol.get("window") or {}
    rows = []
    for source in protocol.get("sources") or []:
        literal = [(source["name"], None, str(q), True) for q in source.get("raw", [])]
        rows += literal + [(source["name"], kind, term, False) for term in protocol.get("terms") or [] for kind in source.get("kinds") or [None]]
    made = [(i, *r, window.get("since"), window.get("until")) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, "seq int, source string, kind string, query string, literal boolean, since string, until string")


def split_to_cap(since: date, until: date, total, cap: int) -> list[tuple[date, date, bool]]:  # noqa: ANN001
    """Windows whose totals keep to a cap, by halving; a day that doesn't is marked as cut short.

    total is a function of a window, as a source's estimate is.
    """
    todo, out = [(since, until)], []
    while todo:
        a, b = todo.pop(0)
        if total(a, b) <= cap or a == b:
            out.append((a, b, total(a, b) > cap))
            continue
        middle = a + timedelta(days=(b - a).days // 2)
        todo = [(a, middle), (middle + timedelta(days=1), b), *todo]
    return out
