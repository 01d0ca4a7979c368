"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language tells how far a text can be parsed by substrings of that language's
text. The number of phrases, times the log of the training length, over the number of characters estimates the
cross-entropy; the language with the least wins. The symbols are the UTF-8 bytes of lower-case letters, so that the
alphabet is open: letters of all scripts are told apart, and a transition table has at most 256 columns. A batch's texts
are parsed in lockstep, a byte of every segment at a time, so that whole texts of any length are read at array speed.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shipped, extend

#: The bounded training sample: so many different units a language, drawn by hash. A unit is a whole document; one of
#: more than UNIT_CHARS characters is cut into units of that size, any of which may be drawn.
SAMPLE_UNITS, UNIT_CHARS = 24, 4_000
#: Least hashes are taken over so many groups a language before the units are drawn from them.
GROUPS = 1024
#: Texts are parsed in segments of so many bytes; a phrase ends at a segment's end, alike for all languages.
SEGMENT = 1 << 14
OTHER, SPACE = 0, 1


class Alphabet:
    """Codes of bytes: 0 bytes not in training, 1 a run of anything but letters, then the bytes of lower-case letters."""

    def __init__(self, texts: list[str]) -> None:
        self.points = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            if (c := chr(i)).isalpha():
                self.points[i] = ord(c.lower()[:1])
        used = np.zeros(256, bool)
        for t in texts:
            used[self.letters(t)] = True
        used[32] = False
        self.size = int(used.sum()) + 2
        self.code = np.full(256, OTHER, np.uint8)
        self.code[np.flatnonzero(used)] = np.arange(2, self.size)
        self.code[32] = SPACE

    def letters(self, text: str) -> np.ndarray:
        """UTF-8 bytes of a text's letters, lower case, each run of other characters a single space; none ends a text."""
        points = self.points[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = points != 32
        keep[1:] |= points[:-1] != 32
        return np.frombuffer(points[keep].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)

    def encode(self, text: str) -> np.ndarray:
        return self.code[self.letters(text)]


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Suffix automaton: the transitions of each state, state 0 first."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new, p = len(go), last
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


class Model:
    """The automata's transitions; the table for all languages is laid out where it is first used and never shipped.

    An entry of the table holds the next state times 4 plus the phrases that the step ends.
    """

    def __init__(self, texts: dict[str, str]) -> None:
        self.languages = sorted(texts)
        self.alphabet = Alphabet([texts[k] for k in self.languages])
        #: For each language the number of transitions of each state, then the code and the next state of each transition.
        self.steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        starts, at, bits = [], 0, []
        for k in self.languages:
            codes = self.alphabet.encode(texts[k])
            go = automaton(codes.tolist())
            sizes = np.fromiter(map(len, go), np.int32, len(go))
            self.steps.append((sizes, np.fromiter((c for s in go for c in s), np.uint8, sizes.sum()), np.fromiter((t for s in go for t in s.values()), np.int32, sizes.sum())))
            starts.append(at)
            at += len(go)
            del go  # before the next one is made
            bits.append(np.log2(max(2, len(codes))))
        self.bits, self.starts = np.array(bits), np.array(starts, np.int32)

    @cached_property
    def table(self) -> np.ndarray:
        out = np.empty((sum(len(sizes) for sizes, _, _ in self.steps), self.alphabet.size), np.int32)
        for at, (sizes, code, to) in zip(self.starts.tolist(), self.steps, strict=True):
            root = np.full(self.alphabet.size, -1, np.int32)
            root[code[: sizes[0]]] = to[: sizes[0]]
            own = out[at : at + len(sizes)]
            # a mismatch ends the phrase at hand, if there is one; an unknown character is a phrase of its own
            own[:] = (np.where(root < 0, 0, root) + at) * 4 + (root < 0)
            own[1:] += 1
            own[np.repeat(np.arange(len(sizes)), sizes), code] = (to + at) * 4
        return out.ravel()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def parse(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases by language (rows) and text (columns)."""
        owner = np.concatenate([np.full(-(-len(c) // SEGMENT), i) for i, c in enumerate(coded)] or [np.zeros(0)]).astype(np.int64)
        pieces = [c[i : i + SEGMENT] for c in coded for i in range(0, len(c), SEGMENT)]
        out = np.zeros((len(self.languages), len(coded)), np.int64)
        for block in range(0, len(pieces), 4096):
            own, some = owner[block : block + 4096], pieces[block : block + 4096]
            sizes = np.array([len(p) for p in some])
            order = np.argsort(-sizes, kind="stable")
            grid = np.zeros((SEGMENT, len(some)), np.int32)
            for column, i in enumerate(order):
                grid[: sizes[i], column] = some[i]
            live = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), side="right")
            state = np.repeat(self.starts[:, None], len(some), axis=1)
            phrases, a = np.zeros(state.shape, np.int32), np.int32(self.alphabet.size)
            for t, k in enumerate(live):
                step = self.table[state[:, :k] * a + grid[t, :k]]
                phrases[:, :k] += step & 3
                state[:, :k] = step >> 2
            phrases += state != self.starts[:, None]
            for row in range(len(out)):
                out[row] += np.bincount(own[order], phrases[row], minlength=len(coded)).astype(np.int64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; `und` and 0 without a letter, or if no language was learned."""
        coded = [self.alphabet.encode(t or "") for t in texts]
        lettered = [bool((c != SPACE).any()) for c in coded]
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        cost = self.parse(coded) * self.bits[:, None] / np.maximum(1, [len(c) for c in coded])
        best = cost.argmin(axis=0)
        low = np.sort(cost, axis=0)
        score = low[1] / np.maximum(low[0] + low[1], 1e-12) if len(low) > 1 else np.ones(len(texts))
        return [self.languages[b] if x else "und" for b, x in zip(best, lettered, strict=True)], [float(s) if x else 0.0 for s, x in zip(score, lettered, strict=True)]


def train(labelled: DataFrame, units: int = SAMPLE_UNITS, unit_chars: int = UNIT_CHARS) -> Model:
    """Learns from columns text and lang: of each language so many different units, whole documents mostly, by hash.

    Copies have one hash, so that a large group of them counts once. Minima of hashes are taken within the map tasks, and
    only the units drawn come to the driver. The tables' size grows with the number of languages alone. Rows without a
    text or lang teach nothing; without any, no language is known.
    """
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{unit_chars}}}+"), F.lit(0))
    cut = F.when(F.length("text") <= unit_chars, F.array("text")).otherwise(pieces)
    some = labelled.where("text is not null and lang is not null").select("lang", F.explode(cut).alias("text")).withColumn("h", F.xxhash64("text"))
    least = some.groupBy("lang", F.pmod("h", F.lit(GROUPS)).alias("g")).agg(F.min("h").alias("h"))
    drawn = least.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= units).drop("g")
    sample = some.join(F.broadcast(drawn), ["lang", "h"]).groupBy("lang", "n").agg(F.min("text").alias("text"))
    texts: dict[str, list[str]] = {}
    for r in sorted(sample.collect()):
        texts.setdefault(r.lang, []).append(r.text)
    return Model({k: "\n".join(v) for k, v in texts.items()})


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, model: Model, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds lang_pred and score (0.5 for a tie of the two best languages, towards 1 the clearer the lead).

    Texts that are null, empty or without a letter get `und` and 0. Ties go to the language that sorts first. Repeated
    rows get the same answer; other columns stay, except those named like an output.
    """
    sent = Shipped(docs.sparkSession, model)

    def fill(batch: pa.RecordBatch) -> list[list]:
        texts, languages, scores = batch.column("text"), [], []
        at = 0
        while at < len(texts):  # a bounded number of characters at a time
            some, chars = [], 0
            while at < len(texts) and (not some or chars < 4_000_000):
                some.append(texts[at].as_py())
                chars += len(some[-1] or "")
                at += 1
            got = sent.value.predict(some)
            languages += got[0]
            scores += got[1]
        return [languages, scores]

    return extend(docs, PREDICTED, fill, drop)
