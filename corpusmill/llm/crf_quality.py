"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its features look at the line and at its neighbours, and transitions tie neighbouring labels.
Forward-backward gives each line's probability of being good, and their mean, weighted by length, is the document's
score. Lines of all documents of a batch are worked through in lockstep, so the chain costs array operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean, extend

#: Labelled documents that the field is fitted on, at most about; drawn by hash from those of so many characters at most.
SAMPLE_DOCS, SAMPLE_CHARS = 4_000, 50_000
SYMBOLS, UPPER, DIGITS, BARS = b"#*$%&<>{}[]\\~^=", bytes(range(65, 91)), b"0123456789", b"|"
FEATURES = ("bias", "log_words", "word_length", "symbols", "bangs", "upper", "digits", "bars", "ends", "repeated", "distinct", "empty")
#: Of these features the line before and the line after count too.
NEAR = (3, 4, 5, 7, 9)


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """One row of features for each line of a text, and the lines' lengths (1 at least)."""
    rows, sizes, seen = [], [], set()
    for line in clean(text).split(b"\n"):
        words = line.split()
        n, chars = len(words), sum(map(len, words))
        share = lambda drop, of, line=line: (len(line) - len(line.translate(None, drop))) / of if of else 0.0
        rows.append((1.0, np.log1p(n) / 4, min(chars / n, 20) / 10 if n else 0.0, min(share(SYMBOLS, n), 1.0), min(share(b"!", n), 1.0), share(UPPER, chars), share(DIGITS, chars), min(share(BARS, n), 1.0), float(line[-1:] in (b".", b"?", b"!")), float(n > 0 and line in seen), len(set(words)) / n if n else 1.0, float(not n)))
        seen.add(line)
        sizes.append(max(1, len(line)))
    x = np.array(rows)
    near = x[:, NEAR]
    edge = np.zeros((1, len(NEAR)))
    return np.hstack([x, np.vstack([edge, near[:-1]]), np.vstack([near[1:], edge])]), np.array(sizes, float)


WIDTH = len(FEATURES) + 2 * len(NEAR)


@dataclass
class Chains:
    """Lines of many documents, padded to one grid: documents sorted by their number of lines, most first."""

    x: np.ndarray
    order: np.ndarray
    at: np.ndarray
    live: np.ndarray

    @staticmethod
    def of(parts: list[np.ndarray]) -> Chains:
        counts = np.array([len(p) for p in parts])
        order = np.argsort(-counts, kind="stable")
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        live = np.searchsorted(-counts[order], -np.arange(1, counts.max() + 1), side="right")
        return Chains(np.vstack(parts), order, starts[order], live)


def marginals(chains: Chains, weights: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of being good, and the expected number of each of the four transitions."""
    emit = np.zeros((len(chains.x), 2))
    emit[:, 1] = chains.x @ weights
    steps, at = len(chains.live), chains.at
    alpha, beta = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
    alpha[at] = emit[at]
    for t in range(1, steps):
        here = at[: chains.live[t]] + t
        alpha[here] = emit[here] + np.logaddexp(alpha[here - 1, :1] + trans[0], alpha[here - 1, 1:] + trans[1])
    for t in range(steps - 2, -1, -1):
        here = at[: chains.live[t + 1]] + t
        ahead = emit[here + 1] + beta[here + 1]
        beta[here] = np.logaddexp(trans[:, 0] + ahead[:, :1], trans[:, 1] + ahead[:, 1:])
    both = alpha + beta
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    pairs = np.zeros((2, 2))
    for t in range(1, steps):
        here = at[: chains.live[t]] + t
        for a in (0, 1):
            for b in (0, 1):
                pairs[a, b] += np.exp(alpha[here - 1, a] + trans[a, b] + emit[here, b] + beta[here, b] - total[here]).sum()
    return good, pairs


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray

    def scores(self, texts: list[str | None]) -> list[float]:
        """A score from 0 to 1 for each text."""
        out: list[float] = []
        at = 0
        while at < len(texts):  # a bounded number of characters at a time
            parts, sizes, chars = [], [], 0
            while at < len(texts) and (not parts or chars < 8_000_000):
                x, n = line_features(texts[at])
                parts.append(x)
                sizes.append(n)
                chars += len(texts[at] or "")
                at += 1
            good, _ = marginals(Chains.of(parts), self.weights, self.trans)
            ends = np.cumsum([len(n) for n in sizes])
            for n, end in zip(sizes, ends, strict=True):
                out.append(float(np.dot(good[end - len(n) : end], n) / n.sum()))
        return out


def fit(texts: list[str | None], labels: list[int], *, rounds: int = 120, rate: float = 0.3, l2: float = 2.0) -> Model:
    """Maximises the likelihood of the labels (each line has its document's) by Adam; without rows all scores are 0.5."""
    model = Model(np.zeros(WIDTH), np.zeros((2, 2)))
    if not texts:
        return model
    parts = [line_features(t)[0] for t in texts]
    chains = Chains.of(parts)
    y = np.concatenate([np.full(len(p), float(v)) for p, v in zip(parts, labels, strict=True)])
    # each document weighs as one line, so that long ones don't decide alone
    n = np.concatenate([np.full(len(p), 1 / len(p)) for p in parts])
    same = np.diag([sum(len(p) - 1 for p, v in zip(parts, labels, strict=True) if v == k) for k in (0, 1)]).astype(float)
    m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for i in range(1, rounds + 1):
        good, pairs = marginals(chains, model.weights, model.trans)
        step = np.concatenate([chains.x.T @ ((y - good) * n), ((same - pairs) / max(1.0, same.sum()) * len(parts) * 0.1).ravel()]) - l2 * 0.01 * np.concatenate([model.weights, model.trans.ravel() * 20])
        m, v = 0.9 * m + 0.1 * step, 0.99 * v + 0.01 * step**2
        move = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-6)
        model.weights = model.weights + move[:WIDTH]
        model.trans = model.trans + move[WIDTH:].reshape(2, 2)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """Fits on about `sample` labelled documents at most, whole texts, drawn by the hash of doc_id.

    Both bounds hold for training alone: longer documents teach nothing, but are scored whole. The labels drawn are few,
    so they are broadcast to the scan of the documents. Null labels are left out.
    """
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    n = known.count()
    share = 1_000_000 if n <= sample else int(1_000_000 * sample / n)
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("crf")), F.lit(1_000_000)) < share)
    rows = sorted((r.doc_id, r.text or "", int(r.quality > 0)) for r in docs.where(F.coalesce(F.length("text"), F.lit(0)) <= chars).select("doc_id", "text").join(F.broadcast(drawn), "doc_id").collect())
    return fit([r[1] for r in rows], [r[2] for r in rows])


SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def score(docs: DataFrame, model: Model, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds score, from 0 to 1. Null and empty texts are one empty line; repeated rows and equal texts get the same score.

    An empty table gives an empty table. Other columns stay, except one named score.
    """

    def fill(batch: pa.RecordBatch) -> list[list]:
        return [model.scores(batch.column("text").to_pylist())]

    return extend(docs, SCORE, fill, drop)
