"""URL filter: rules on hosts and paths decide where they fit; elsewhere gradient-boosted trees on lexical features do.

The trees are fitted on a bounded sample of the URLs that a rule labels (MAX_SAMPLE rows, drawn by hash), on quantised
features, and applied to all URLs batch by batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered, private

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MAX_SAMPLE = 20_000
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "host_entropy", "parameters", "suffix_length", "suffix_block_rate", "longest_label", "has_fragment", "secure")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or where `://` is missing."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lowered(host), path


def ruled(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, says_in: str = "said") -> DataFrame:
    """Adds host, path and the longest fitting rule (null without one), with what it says in column says_in."""
    host, path = host_and_path(F.col("url"))
    out = pages.withColumns({"host": host, "path": path})
    said, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        site, _, start = name.partition("/")
        fits = ((F.col("host") == site) | F.col("host").endswith("." + site)) & F.col("path").startswith("/" + start)
        said, rule = F.when(fits, says).otherwise(said), F.when(fits, name).otherwise(rule)
    return out.withColumns({"rule": rule, says_in: said})


def entropy(text: str) -> float:
    """Shannon entropy of a string's characters, in bits."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in (text.count(x) for x in set(text))) if n else 0.0


def lexical(url: str | None, host: str, path: str, suffixes: dict[str, float]) -> list[float]:
    """The features of one URL, in the order of FEATURES."""
    url = url or ""
    labels = host.split(".")
    query = url.partition("?")[2].partition("#")[0]
    digits = lambda s: sum(c.isdigit() for c in s) / max(1, len(s))
    return [len(url), len(host), len(path), path.count("/"), len(labels), digits(url), digits(host), host.count("-"), entropy(url), entropy(host), sum(1 for x in query.split("&") if x), len(labels[-1]), suffixes.get(labels[-1], suffixes.get("", 0.5)), max(map(len, labels)), float("#" in url), float(url.startswith("https://"))]


@dataclass
class Trees:
    """Boosted regression trees on quantised features; each tree is a list of (feature, cut, left, right, value)."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple[int, int, int, int, float]]] = field(default_factory=list)
    start: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of block by row."""
        if not len(x):
            return np.zeros(0)
        b, score, rows = self.bins(x) if self.edges else None, np.full(len(x), self.start), np.arange(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            feature, cut, left, right = (np.array([t[k] for t in tree]) for k in range(4))
            value = np.array([t[4] for t in tree])
            for _ in range(len(tree)):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go_left = b[rows, np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go_left, left[at], right[at]), at)
            score += value[at]
        return 1 / (1 + np.exp(-score))


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Fits the trees by Newton steps on histograms; without rows or with one class it answers the mean alone."""
    n = len(y)
    p = (y.sum() + 1) / (n + 2) if n else 0.5
    model = Trees(start=math.log(p / (1 - p)))
    if not n or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b, score = model.bins(x), np.full(n, model.start)
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-score))
        g, h, tree = y - prob, prob * (1 - prob), []

        def grow(rows: np.ndarray, level: int, g: np.ndarray = g, h: np.ndarray = h, tree: list = tree) -> int:
            at, best = len(tree), (1e-6, -1, -1)
            tree.append(None)
            gs, hs = g[rows].sum(), h[rows].sum()
            if level < depth:
                for j in range(x.shape[1]):
                    gl, hl = (np.cumsum(np.bincount(b[rows, j], w[rows], minlength=bins + 1))[:-1] for w in (g, h))
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(hl < least * 0.05) | (hs - hl < least * 0.05)] = -1
                    if gain[k := int(gain.argmax())] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] < 0:
                tree[at] = (-1, 0, 0, 0, rate * gs / (hs + l2))
                return at
            on = b[rows, best[1]] <= best[2]
            left = grow(rows[on], level + 1)
            tree[at] = (best[1], best[2], left, grow(rows[~on], level + 1), 0.0)
            return at

        grow(np.arange(n), 0)
        model.trees.append(tree)
        one = Trees(model.edges, [tree], 0.0).predict(x)
        score += np.log(one / (1 - one))
    return model


def train(labelled: DataFrame, max_sample: int = MAX_SAMPLE, says_in: str = "said") -> tuple[Trees, dict[str, float]]:
    """Trees and the block rate of each suffix, from at most about max_sample labelled rows, drawn by the URL's hash.

    A row that the trees are fitted on has its own label left out of its suffix's rate. Without labelled rows (an empty
    table, or no rule that fits) the trees answer 0.5.
    """
    known = labelled.select("url", "page_id", "host", "path", F.col(says_in).alias("said")).where("said is not null")
    n = known.count()
    share = 1_000_000 if n <= max_sample else int(1_000_000 * max_sample / n)
    drawn = known.where(F.pmod(F.xxhash64("url", "page_id"), F.lit(1_000_000)) < share).select("url", "host", "path", "said").collect()
    rows = sorted(((r.url or "", r.host, r.path, r.said) for r in drawn))
    y = np.array([float(r[3] == "block") for r in rows])
    by: dict[str, list[float]] = {}
    for r, v in zip(rows, y, strict=True):
        by.setdefault(r[1].rpartition(".")[2], []).append(v)
    base = float(y.mean()) if len(y) else 0.5
    # the mean of a suffix is drawn towards that of all, by 20 rows
    suffixes = {k: (sum(v) + 20 * base) / (len(v) + 20) for k, v in sorted(by.items())} | {"": base}
    x = np.array([lexical(u, h, p, suffixes) for u, h, p, _ in rows]).reshape(-1, len(FEATURES))
    for row, r, v in zip(x, rows, y, strict=True):
        n = len(by[r[1].rpartition(".")[2]])
        row[FEATURES.index("suffix_block_rate")] += (row[FEATURES.index("suffix_block_rate")] - v) / (n + 19)
    return boost(x, y), suffixes


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, *, max_sample: int = MAX_SAMPLE, threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, block_score (the trees' probability) and verdict to every page.

    Null URLs and those without `://` have an empty host and path, and get the trees' verdict on the whole string.
    Without any page that a rule labels, the trees answer 0.5 for block, and block wins ties. Repeated rows are judged
    alike; columns of the input stay, except those named like an output.
    """
    said = private(pages, "said")
    marked = ruled(pages, rules, said)
    model, suffixes = train(marked, max_sample, said)
    keep = [c for c in marked.columns if c.lower() not in ("block_score", "verdict")]
    schema = marked.select(*keep).schema.add("block_score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            url, host, path = (batch.column(c).to_pylist() for c in ("url", "host", "path"))
            x = np.array([lexical(*row, suffixes) for row in zip(url, host, path, strict=True)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.predict(x), pa.float64())], names=[*keep, "block_score"])

    scored = marked.select(*keep).mapInArrow(score, schema)
    learned = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce(F.col(said), learned)).drop(said)
