"""Secret scan: fixed credential patterns, and candidate strings whose sliding-window entropy is that of random keys.

All native. The entropy of each window of WINDOW characters comes from the one before by two count changes: the
character that leaves and the one that enters. It is measured for each character class (hexadecimal, letters and digits,
base64) over the windows that consist of that class alone, against what the class can reach; an allow-list of known
harmless shapes suppresses candidates. Repeated groups are possessive: Java matches those in a loop, others by recursion,
which a text of a few thousand repetitions would drive out of its stack.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, whole
from .spans import clear_of, find, kinds

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The shortest match counts are in the patterns, where a shorter match can't hide another.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: class, ranges of its ASCII codes, bits a character in some window of it.
CLASSES = (("hex", ((48, 57), (65, 70), (97, 102)), 3.0), ("alnum", ((48, 57), (65, 90), (97, 122)), 3.7), ("base64", ((43, 43), (45, 45), (47, 57), (61, 61), (65, 90), (95, 95), (97, 122)), 3.9))
#: Shapes of harmless strings: UUIDs, placeholders, runs of one character, paths and hyphenated or underscored words.
ALLOWED = (r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", r"(?i)(example|sample|dummy|placeholder|changeme|xxxx)", r"(.)\1{7}", r"^/?(?:[A-Za-z]++[0-9]{0,3}+[/_=+-])++[A-Za-z]*+[0-9]{0,3}$", r"^[0-9_=/+-]+$")
#: A random key mixes digits and letters.
MIXED = r"(?=.*[0-9])(?=.*[A-Za-z])"


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """A struct: for each class, the largest Shannon entropy, in bits a character, of any window of an ASCII string that
    consists of the class; 0 without one.

    The counts of the window's characters are a binary of 128 bytes, of which a step changes two.
    """
    weigh = F.array(*map(F.lit, [0.0, *(c * math.log2(c) for c in range(1, window + 2))]))
    names = [name for name, _, _ in CLASSES]
    zero = F.struct(F.unhex(F.lit("00" * 128)).alias("counts"), F.lit(0.0).alias("sum"), *(F.lit(0).alias(f"run_{n}") for n in names), *(F.lit(0.0).alias(n) for n in names))
    byte = lambda data, at: F.ascii(F.substring(data, at + 1, F.lit(1)).cast("string"))
    with_count = lambda counts, code, n: F.overlay(counts, F.char(n).cast("binary"), code + 1, F.lit(1))

    def of(data: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new, old = byte(data, i), byte(data, i - window)
            full = i >= window
            n_old = byte(acc["counts"], old)
            left = F.when(full, with_count(acc["counts"], old, n_old - 1)).otherwise(acc["counts"])
            n_new = byte(left, new)
            total = acc["sum"] + F.when(full, F.get(weigh, n_old - 1) - F.get(weigh, n_old)).otherwise(0.0) + F.get(weigh, n_new + 1) - F.get(weigh, n_new)
            runs, bests = [], []
            for name, ranges, _ in CLASSES:
                member = F.lit(False)
                for low, high in ranges:
                    member = member | new.between(low, high)
                run = F.when(member, acc[f"run_{name}"] + 1).otherwise(0)
                runs.append(run.alias(f"run_{name}"))
                bests.append(F.when(run >= window, F.greatest(acc[name], F.lit(math.log2(window)) - total / window)).otherwise(acc[name]).alias(name))
            return F.struct(with_count(left, new, n_new + 1).alias("counts"), total.alias("sum"), *runs, *bests)

        return F.aggregate(F.sequence(F.lit(0), F.octet_length(data) - 1), zero, step, lambda acc: F.struct(*(acc[n].alias(n) for n in names)))

    short = F.struct(*(F.lit(0.0).alias(n) for n in names))
    return F.when(F.length(text) < window, short).otherwise(let(text.cast("binary"), of))


def random_looking(text: Column) -> Column:
    """Whether a candidate's entropy in some class reaches the class's threshold and no allowed shape fits it."""
    allowed = F.lit(False)
    for shape in ALLOWED:
        allowed = allowed | text.rlike(shape)

    def reaches(e: Column) -> Column:
        out = F.lit(False)
        for name, _, bits in CLASSES:
            out = out | (e[name] >= bits)
        return out

    return F.when(text.rlike(MIXED) & ~allowed, let(window_entropy(text), reaches)).otherwise(False)


def scan(docs: DataFrame) -> DataFrame:
    """Adds base (array of struct<start, order, end, kind, text> of assign, access and hex) and secrets (base and entropy).

    Null and empty texts have none, an empty table gives an empty table. Entropy spans that share a character with a base
    span are left out. A span's places are code points, end exclusive. Spans that begin together are in the order of
    their kinds. Repeated rows get the same spans; other columns stay, except those named like an output. The work is
    linear in a text's length but for a logarithm of its number of spans.
    """
    text = whole()
    assign = F.filter(find(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 12)
    base = kinds({"assign": assign, "access": find(text, ACCESS, F.contains(text, F.lit("AKIA"))), "hex": find(text, HEX)})
    out = docs.withColumn("base", base)
    entropy = F.transform(fresh_spans(text), lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("order"), s["end"].alias("end"), F.lit("entropy").alias("kind"), s["text"].alias("text")))
    return out.withColumn("secrets", F.sort_array(F.concat(F.col("base"), entropy)))


def fresh_spans(text: Column) -> Column:
    """Random-looking candidates away from the spans of column base."""
    return F.filter(clear_of(find(text, CANDIDATE), F.col("base")), lambda s: random_looking(s["text"]))
