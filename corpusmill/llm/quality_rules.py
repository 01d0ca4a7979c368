"""Quality rules as weak supervision: rules vote or abstain, EM estimates how each rule votes on good and on bad
documents, and the posterior probability of quality replaces all-must-pass filtering.

Everything per document is a native expression. EM needs only how often each vote pattern occurs, so the driver gets
at most 3 ** len(RULES) rows whatever the corpus holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, private, stored, whole, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A word of letters, with punctuation around it.
PLAIN = r"""(?<![^\x20\x09-\x0D])["'(]?+\p{L}[\p{L}\p{M}'\u2019-]*+[.,;:!?)"']{0,3}+(?![^\x20\x09-\x0D])"""
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: name, share, bad above, good below (the other way round where bad < good); between them the rule abstains.
RULES = (
    ("symbols", "n_symbols / n_words", 0.2, 0.03),
    ("shouting", "n_bangs / n_words", 0.1, 0.01),
    ("capitals", "n_upper / greatest(word_chars, 1)", 0.4, 0.15),
    ("repetition", "greatest(n_dup_lines / n_lines, n_repeat_words / n_words)", 0.5, 0.3),
    ("long_words", "word_chars / n_words", 14.0, 10.0),
    ("digits", "n_digits / greatest(word_chars, 1)", 0.3, 0.05),
    ("plain_words", "n_plain_words / n_words", 0.75, 0.93),
    ("symbol_lines", "n_symbol_lines / n_lines", 0.5, 0.1),
    ("line_ends", "n_ended_lines / n_lines", 0.1, 0.5),
)


def repeat_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words inside windows of so many words that the text holds twice or more, the first occurrence included.

    Windows are compared by a 64-bit hash. Only texts with a repeated window sort their windows.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            n = F.size(s)
            twin = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(placed, positions), total)

    def of(tokens: Column) -> Column:
        hashes = let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window))))
        once = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
        return F.when(F.size(tokens) <= window, F.lit(0)).otherwise(let(hashes, once))

    return of(tokens).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """Adds the counts that the rules look at. Null texts count as empty; all other columns stay."""
    text = whole()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    matching = lambda x, pattern: F.size(F.filter(x, lambda y: y.rlike(pattern))).cast("long")
    from_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    from_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), matching(x, rf"[{SYMBOLS}].*[{SYMBOLS}]").alias("n_symbol_lines"), matching(x, r"""[.!?:;]["')\]]?[\x20\x09-\x0D]*+$""").alias("n_ended_lines")))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    w = private(docs, "counted")
    made = docs.withColumn(w, F.struct(from_words.alias("w"), from_lines.alias("l")))
    made = made.withColumns({
        "n_words": F.col(f"{w}.w.n_words"), "n_repeat_words": F.col(f"{w}.w.n_repeat_words"), "n_lines": F.col(f"{w}.l.n_lines"), "n_dup_lines": F.col(f"{w}.l.n_dup_lines"),
        "n_symbol_lines": F.col(f"{w}.l.n_symbol_lines"), "n_ended_lines": F.col(f"{w}.l.n_ended_lines"), "n_plain_words": count(PLAIN),
        "word_chars": F.length(text).cast("long") - count(r"[\x20\x09-\x0D]"), "n_symbols": count(f"[{SYMBOLS}]"), "n_bangs": count("!!"),
        "n_upper": count(r"\p{Lu}"), "n_digits": count("[0-9]"),
    })
    return made.drop(w)


def vote(share: str, bad: float, good: float) -> Column:
    """-1 votes bad, 1 good, 0 abstains; texts without words get abstentions."""
    x = F.expr(share)
    is_bad, is_good = (x > bad, x < good) if bad > good else (x < bad, x > good)
    return F.when(F.col("n_words") == 0, 0).when(is_bad, -1).when(is_good, 1).otherwise(0)


#: What is believed before any data: the share of good documents, and how often a rule votes -1, 0 and 1 on good and on
#: bad ones. It counts as TRUST documents, however many there are.
BALANCE, BELIEF, TRUST = 0.7, {-1: (0.02, 0.4), 0: (0.08, 0.2), 1: (0.9, 0.4)}, 100.0


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, trust: float = TRUST) -> tuple[float, list[dict[int, float]]]:
    """EM over vote patterns and their counts: the log prior odds of good, and each rule's log odds by vote.

    The classes' balance and how each rule votes on either class are estimated, from BALANCE and BELIEF on. A rule is
    taken to be no worse than chance: its bad vote never speaks for good, nor its good vote for bad, which keeps the
    classes' meaning. Repeatable: patterns are sorted. Without patterns what is believed holds.
    """
    patterns = sorted(patterns)
    n_rules = len(patterns[0][0]) if patterns else len(RULES)
    prior, odds = math.log(BALANCE / (1 - BALANCE)), [{v: math.log(g / b) for v, (g, b) in BELIEF.items()} for _ in range(n_rules)]
    good: list[float] = []
    for _ in range(rounds):
        logits = [prior + sum(o[v] for o, v in zip(odds, p, strict=True)) for p, _ in patterns]
        new = [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in logits]
        moved, good = max((abs(a - b) for a, b in zip(new, good, strict=False)), default=1.0), new
        if moved < 1e-9:
            break
        total = sum(c for _, c in patterns)
        n_good = sum(c * g for (_, c), g in zip(patterns, good, strict=True))
        share = (n_good + trust * BALANCE) / (total + trust)
        prior, odds = math.log(share / (1 - share)), []
        for r in range(n_rules):
            by = {}
            for v, (in_good, in_bad) in BELIEF.items():
                held_good = sum(c * g for (p, c), g in zip(patterns, good, strict=True) if p[r] == v)
                held_bad = sum(c * (1 - g) for (p, c), g in zip(patterns, good, strict=True) if p[r] == v)
                by[v] = math.log((held_good + trust * in_good) / (n_good + trust) / ((held_bad + trust * in_bad) / (total - n_good + trust)))
            odds.append(by | {-1: min(by[-1], 0.0), 1: max(by[1], 0.0)})
    return prior, odds


def judge(docs: DataFrame, **options: float) -> DataFrame:
    """Adds the measures, the votes, `base_failed`, the `posterior` probability of quality, and `kept` to every document.

    Null and empty texts have no words: they fail the base rule. Repeated rows are judged alike and all stay. Any
    columns of the input stay, but those named like an output are replaced. An empty table gives an empty table.
    """
    return judge_measured(measures(docs), **options)


def judge_measured(measured: DataFrame, *, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, threshold: float = 0.5) -> DataFrame:
    """`judge` for documents that have their measures; they need no text. The rows are checkpointed once."""
    names = [f"vote_{r[0]}" for r in RULES]
    voted = stored(measured.withColumns({n: vote(*r[1:]) for n, r in zip(names, RULES, strict=True)}))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counts = [(tuple(r[n] for n in names), r["count"]) for r in voted.where(~failed).groupBy(*names).count().collect()]
    prior, odds = fit(counts)
    logit = F.lit(prior)
    for n, by in zip(names, odds, strict=False):
        logit = logit + F.when(F.col(n) == 1, by[1]).when(F.col(n) == -1, by[-1]).otherwise(by[0])
    out = voted.withColumns({"base_failed": failed, "posterior": 1 / (1 + F.exp(-logit))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
