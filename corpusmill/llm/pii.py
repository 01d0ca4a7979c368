"""Personal data by weak supervision: shape, gazetteer and context labelers vote on candidate spans, EM estimates how
reliable each labeler is, and a span classifier trained on the resulting labels makes the final decision.

All native. Candidates are the fixed base patterns, whose spans always stay, and looser ones, which stay if the
classifier says so. The driver sees only how often each combination of kind, votes and features occurs: a table whose
size the numbers of kinds, votes and buckets bound. Repeated groups are possessive or bounded, so that Java matches them
in a loop: a group repeated without bound would recurse once a repetition. The patterns match what the plain ones match.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, private, whole, written
from .spans import chunked, clear_of, find, kinds, piece

#: `\\G` lets a match begin where the one before ended, inside a run of the same characters.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of digits with single separators; runs of other lengths fail, so only 12 to 19 digits are looked for.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TITLES = r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Mme|Mlle|Sr|Sra|Sig)"
LOOSE = {
    "spelled_email": r"\b[A-Za-z0-9_+-]{2,40}\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]{2,40}\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?[A-Za-z]{2,10}\b",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "name": TITLES + r"\.?\x20\p{Lu}\p{L}{1,30}(?:\x20\p{Lu}\p{L}{1,30})?",
}
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *LOOSE)
VOTES = ("shape", "gazetteer", "context")
FEATURES = ("cue", "size", "digits", "separators")
#: Characters before a span in which its context is looked for.
CONTEXT_CHARS = 32
#: Words before a span, by what they speak of; `against` stands before numbers that are no personal data.
CUES = {
    "contact": r"(?i)(?:e-?mail|mail|contact|write|reach|phone|tel|telephone|call|fax|mobile|cell|sms|whatsapp)\P{L}{0,8}(?:(?:me|us|at|to|on|is|no|nr)\P{L}{1,8}){0,2}$",
    "money": r"(?i)(?:card|visa|mastercard|amex|account|iban|bank|credit|debit|payment)\P{L}{0,8}(?:(?:number|no|nr|is)\P{L}{1,8}){0,2}$",
    "person": r"(?i)(?:ssn|social|security|name|signed|dear|sincerely|regards|born|patient|customer|client|employee)\P{L}{0,8}(?:(?:number|no|nr|is)\P{L}{1,8}){0,2}$",
    "machine": r"(?i)(?:ip|address|host|server|login|from|user)\P{L}{0,8}(?:(?:at|is)\P{L}{1,8}){0,2}$",
    "against": r"(?i)(?:version|v|isbn|issn|hash|order|invoice|section|figure|table|page|build|release|part|model|serial)\P{L}{0,8}$",
}
#: The cues that speak for each kind.
FITTING = {"email": ("contact", "person", "machine"), "spelled_email": ("contact", "person"), "phone": ("contact", "person"), "local_phone": ("contact", "person"), "card": ("money", "person"), "iban": ("money",), "ssn": ("person",), "name": ("person", "contact"), "ip": ("machine",)}


@dataclass(frozen=True)
class Gazetteers:
    """The tables that the gazetteer labeler looks things up in; all are parameters. Fixed values of public lists."""

    domains: tuple[str, ...] = tuple("com org net edu gov mil int info biz name pro io ai app dev me tv co ac ad ae ar at au be bg br ca ch cl cn cz de dk ee es eu fi fr gr hk hr hu id ie il in is it jp ke kr kz lt lu lv ma mx my ng nl no nz pe ph pk pl pt ro rs ru sa se sg si sk th tr tw ua uk us uy ve vn za".split())
    given_names: tuple[str, ...] = tuple("Ana Andrea Andrew Anna Antonio Barbara Carlos Carmen Charles Christine Claire Daniel David Elena Elizabeth Emma Eva Francisco Frank George Hans Helen Ines Isabel Jacques James Jan Jane Jean Jennifer Jessica Johann John Jorge Jose Joseph Juan Julia Julie Karen Karl Klaus Laura Linda Lisa Louis Lucas Luis Manuel Marco Margaret Maria Marie Mark Marta Martin Mary Michael Michel Monica Nancy Nicolas Olivia Patricia Paul Pedro Peter Philippe Pierre Rachel Richard Robert Rosa Sandra Sarah Sofia Sophie Stefan Susan Teresa Thomas Victor William Wolfgang".split())
    #: Length of an account number by country.
    ibans: tuple[tuple[str, int], ...] = (("AT", 20), ("BE", 16), ("BG", 22), ("CH", 21), ("CY", 28), ("CZ", 24), ("DE", 22), ("DK", 18), ("EE", 20), ("ES", 24), ("FI", 18), ("FR", 27), ("GB", 22), ("GR", 27), ("HR", 21), ("HU", 28), ("IE", 22), ("IS", 26), ("IT", 27), ("LI", 21), ("LT", 20), ("LU", 20), ("LV", 21), ("MT", 31), ("NL", 18), ("NO", 15), ("PL", 28), ("PT", 25), ("RO", 24), ("SE", 24), ("SI", 19), ("SK", 24), ("TR", 26))
    #: Country calling codes, and issuers' first digits of cards, as patterns.
    calling: str = r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-368]|22[0-9]|23[0-9]|24[0-9]|25[0-8]|26[0-9]|29[017-9]|35[0-9]|37[0-9]|38[0-35-79]|42[013]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|85[0-6]|88[06]|96[0-8]|97[0-7]|99[2-68])"
    issuers: str = r"^(4|5[1-5]|2[2-7]|3[47]|3[068]|6)"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def of(d: Column) -> Column:
        n = F.length(d)

        def add(total: Column, i: Column) -> Column:
            v = F.substring(d, i, F.lit(1)).cast("int")
            twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
            return total + F.when((n - i) % 2 == 1, twice).otherwise(v)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0

    return F.when(F.length(number) > 0, let(number, of)).otherwise(False)


def iban_check(text: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four characters put last and letters read as 10 to 35."""

    def of(t: Column) -> Column:
        def add(rest: Column, c: Column) -> Column:
            v = F.ascii(c)
            return F.when(v < 65, (rest * 10 + v - 48) % 97).otherwise((rest * 100 + v - 55) % 97)

        turned = F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, F.lit(1), F.lit(4)))
        return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), add) == 1

    return let(F.regexp_replace(text, "[^A-Z0-9]", ""), of)


def small_parts(ip: Column) -> Column:
    """Whether every part of an address is at most 255, leading zeros aside."""
    return F.forall(F.split(ip, r"\."), lambda p: F.regexp_replace(p, "^0++(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def spotted(text: Column) -> Column:
    """Candidates of all kinds: array of struct<start, order, end, kind, text>."""
    has_digits = text.rlike("[0-9]")
    n = lambda s: F.length(digits(s["text"]))
    found = {
        "email": find(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(find(text, IP, has_digits), lambda s: small_parts(s["text"])),
        "card": F.filter(find(text, CARD, has_digits), lambda s: luhn(digits(s["text"]))),
        "phone": F.filter(find(text, PHONE, F.contains(text, F.lit("+"))), lambda s: n(s).between(9, 15)),
    }
    cheap = {"spelled_email": text.rlike(r"(?:at|AT)\x20?[\])]"), "local_phone": has_digits, "ssn": has_digits, "iban": has_digits, "name": text.rlike(TITLES + r"\b")}
    return kinds(found | {k: find(text, p, cheap[k]) for k, p in LOOSE.items()})


def by_kind(kind: Column, values: dict[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for k, v in values.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def voted(s: Column, chunks: Column, lists: Gazetteers) -> Column:
    """A candidate with the votes of the three labelers (1 for personal data, -1 against, 0 abstains) and its features."""
    t, kind = s["text"], s["kind"]
    left = piece(chunks, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)), s["start"])
    after = piece(chunks, s["end"], s["end"] + 1)

    def of(c: Column) -> Column:
        one_of = lambda value, table: F.array_contains(F.array(*map(F.lit, table)), value)
        bare = F.regexp_replace(t, "[^A-Z0-9]", "")
        lengths = F.concat(F.substring(bare, 1, 2), F.length(bare).cast("string"))
        right = by_kind(kind, {"iban": iban_check(t), "ssn": ~t.rlike(r"^(000|666|9)|-00-|-0000$"), "local_phone": t.rlike(r"^\(?[2-9][0-8][0-9]\)?[\x20.-][2-9]"), "card": ~digits(t).rlike(r"^([0-9])\1*+$")}, F.lit(True))
        alone = ~c["left"].rlike(r"[\p{L}\p{N}]$") & ~c["after"].rlike(r"^[\p{L}\p{N}]")
        listed = by_kind(kind, {
            "email": one_of(F.lower(F.regexp_extract(t, r"\.([A-Za-z0-9-]+)$", 1)), lists.domains),
            "spelled_email": one_of(F.lower(F.regexp_extract(t, r"([A-Za-z]+)$", 1)), lists.domains),
            "ip": ~t.rlike(r"^(0|127|255|22[4-9]|23[0-9]|24[0-9])\."), "card": digits(t).rlike(lists.issuers), "phone": t.rlike(lists.calling),
            "iban": one_of(lengths, [f"{k}{n}" for k, n in lists.ibans]),
            "name": one_of(F.regexp_extract(t, r"\x20(\p{L}+)", 1), lists.given_names),
        }, F.lit(None).cast("boolean"))
        cue = F.lit("none")
        for name, pattern in CUES.items():
            cue = F.when(c["left"].rlike(pattern), name).otherwise(cue)

        def made(x: Column) -> Column:
            fits = F.lit(False)
            for k, names in FITTING.items():
                fits = fits | ((kind == k) & x.isin(*names))
            share = F.length(digits(t)) / F.length(t)
            kinds_of = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(r"[^\p{L}\p{N}]"), F.lit(0))))
            fields = {
                "start": s["start"], "order": s["order"], "end": s["end"], "kind": kind, "text": t, "base": kind.isin(*BASE),
                "shape": F.when(alone & right, 1).otherwise(-1), "gazetteer": F.when(listed, 1).when(~listed, -1).otherwise(0),
                "context": F.when(x == "against", -1).when(fits, 1).otherwise(0),
                "cue": F.when(x == "against", "against").when(fits, "fits").when(x == "none", "none").otherwise("other"), "size": F.least(F.floor(F.length(t) / 8), F.lit(3)).cast("int"),
                "digits": F.when(share == 0, 0).when(share < 0.5, 1).otherwise(2), "separators": F.least(kinds_of, F.lit(2)),
            }
            return F.struct(*(v.alias(k) for k, v in fields.items()))

        return let(cue, made)

    return let(F.struct(left.alias("left"), after.alias("after")), of)


NO_CANDIDATES = "array<struct<start:int,order:int,end:int,kind:string,text:string,base:boolean,shape:int,gazetteer:int,context:int,cue:string,size:int,digits:int,separators:int>>"


def candidates(docs: DataFrame, name: str = "cands", lists: Gazetteers | None = None) -> DataFrame:
    """Adds candidates: array of struct<start, order, end, kind, text, base, VOTES, FEATURES>, sorted by start and kind."""
    text = whole()
    made = lambda x: F.when(F.size(x) == 0, F.array().cast(NO_CANDIDATES)).otherwise(let(chunked(text), lambda chunks: F.transform(x, lambda s: voted(s, chunks, lists or Gazetteers()))))
    return docs.withColumn(name, let(spotted(text), made))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


#: What is believed before any data: the share of personal data among the candidates of base and of loose kinds, and how
#: often each labeler votes 1, 0 and -1 on personal data and on other candidates. TRUST candidates' worth of it counts.
SHARE = {True: 0.9, False: 0.2}
BELIEF = {"shape": ((0.9, 0.02, 0.08), (0.4, 0.02, 0.58)), "gazetteer": ((0.6, 0.3, 0.1), (0.15, 0.4, 0.45)), "context": ((0.4, 0.57, 0.03), (0.05, 0.75, 0.2))}
TRUST = 20.0
Rows = list[tuple[dict, int]]


def reliabilities(rows: Rows, rounds: int = 100) -> tuple[dict[str, tuple], dict[str, float], list[float]]:
    """EM: how often each labeler votes 1, 0, -1 on personal data and on the rest, each kind's share of personal data, and
    the probability of personal data for each row (a dict of kind, votes and features, and its count)."""
    tables, share = dict(BELIEF), {k: SHARE[k in BASE] for k in KINDS}
    posterior: list[float] = []
    for _ in range(rounds):
        new = []
        for row, _ in rows:
            logit = math.log(share[row["kind"]] / (1 - share[row["kind"]]))
            logit += sum(math.log(tables[v][0][1 - row[v]] / tables[v][1][1 - row[v]]) for v in VOTES)
            new.append(sigmoid(logit))
        moved, posterior = max((abs(a - b) for a, b in zip(new, posterior, strict=False)), default=1.0), new
        held: dict = {v: [[TRUST * p for p in side] for side in BELIEF[v]] for v in VOTES}
        of = {k: [TRUST * SHARE[k in BASE], TRUST] for k in KINDS}
        for (row, count), p in zip(rows, posterior, strict=True):
            for v in VOTES:
                held[v][0][1 - row[v]] += count * p
                held[v][1][1 - row[v]] += count * (1 - p)
            of[row["kind"]][0] += count * p
            of[row["kind"]][1] += count
        tables = {v: tuple(tuple(x / sum(side) for x in side) for side in held[v]) for v in VOTES}
        share = {k: min(0.999, max(0.001, a / n)) for k, (a, n) in of.items()}
        if moved < 1e-9:
            break
    return tables, share, posterior


def features(row: dict) -> list[str]:
    """Names of the features that hold for a row; what describes a span's form is told apart by kind.

    There is no bias that kinds share: a kind without candidates to learn from keeps its prior weight.
    """
    kind = row["kind"]
    return [f"kind={kind}", f"cue={row['cue']}", f"gazetteer={row['gazetteer']}", f"shape={row['shape']}", *(f"{kind}:{f}={row[f]}" for f in FEATURES[1:])]


def prior_weight(name: str) -> float:
    """The weight that a feature has before training, and is drawn to."""
    if name.startswith("kind="):
        p = SHARE[name[5:] in BASE]
        return math.log(p / (1 - p))
    return {"cue=fits": 1.0, "cue=against": -2.0, "gazetteer=1": 1.0, "gazetteer=-1": -1.0, "shape=-1": -2.0}.get(name, 0.0)


def fit(found: DataFrame, name: str = "cands", *, rounds: int = 300, rate: float = 0.5, pull: float = 0.01) -> dict[str, float]:
    """Weights of the span classifier: logistic regression on EM's probabilities, over the table of combinations."""
    fields = ("kind", *VOTES, *FEATURES)
    counted = found.select(F.explode(F.col(name)).alias("c")).groupBy(*(F.col(f"c.{f}").alias(f) for f in fields)).count()
    rows = sorted(((tuple(r[f] for f in fields), r["count"]) for r in counted.collect()), key=repr)
    table: Rows = [(dict(zip(fields, r, strict=True)), c) for r, c in rows]
    _, _, target = reliabilities(table)
    named = [features(r) for r, _ in table]
    weights = {n: prior_weight(n) for names in named for n in names}
    total = sum(math.sqrt(c) for _, c in table) or 1.0
    for _ in range(rounds):
        step = {n: pull * (prior_weight(n) - w) for n, w in weights.items()}
        for names, (_, count), goal in zip(named, table, target, strict=True):
            error = math.sqrt(count) / total * (goal - sigmoid(sum(weights[n] for n in names)))
            for n in names:
                step[n] += error
        for n, d in step.items():
            weights[n] += rate * d
    return weights


def classified(found: DataFrame, weights: dict[str, float], name: str = "cands", threshold: float = 0.5) -> DataFrame:
    """Adds spans (array of struct<start, order, end, kind, text, base, probability>) from the candidates, which go.

    Base spans stay whatever the classifier says; others stay if it says so and no base span shares a character.
    """
    weight = F.create_map(*(F.lit(x) for n, w in sorted(weights.items()) for x in (n, w))) if weights else F.create_map().cast("map<string,double>")

    def scored(c: Column) -> Column:
        kind = c["kind"]
        own = SHARE[False]
        prior = F.when(c["base"], math.log(SHARE[True] / (1 - SHARE[True]))).otherwise(math.log(own / (1 - own)))
        logit = F.coalesce(F.element_at(weight, F.concat(F.lit("kind="), kind)), prior)
        for f in ("cue", "gazetteer", "shape"):
            fallback = F.lit(0.0)
            for value in ("fits", "against", "1", "-1"):
                fallback = F.when(c[f].cast("string") == value, prior_weight(f"{f}={value}")).otherwise(fallback)
            logit = logit + F.coalesce(F.element_at(weight, F.concat(F.lit(f"{f}="), c[f].cast("string"))), fallback)
        for f in FEATURES[1:]:
            logit = logit + F.coalesce(F.element_at(weight, F.concat(kind, F.lit(f":{f}="), c[f].cast("string"))), F.lit(0.0))
        return F.struct(*(c[x].alias(x) for x in ("start", "order", "end", "kind", "text", "base")), (1 / (1 + F.exp(-logit))).alias("probability"))

    def chosen(x: Column) -> Column:
        bases = F.filter(x, lambda s: s["base"])
        others = F.filter(x, lambda s: ~s["base"] & (s["probability"] >= threshold))
        return let(bases, lambda b: F.sort_array(F.concat(b, clear_of(others, b))))

    out = found.withColumn("spans", let(F.transform(F.col(name), scored), chosen))
    return out if name.lower() == "spans" else out.drop(name)


def detect(docs: DataFrame, lists: Gazetteers | None = None) -> DataFrame:
    """Adds spans, sorted by start and kind, to every document.

    Null and empty texts have none; a table without any candidate trains nothing and finds nothing, an empty table gives
    an empty table. Places are code points, end exclusive; spans that begin together are in the order of KINDS. Repeated
    rows get the same spans; other columns stay, except one named spans. The candidates are written once, with the
    documents, so that the patterns run once. The work is linear in a text's length but for a logarithm of its number of
    candidates.
    """
    name = private(docs, "candidates")
    found = written(candidates(docs, name, lists), "pii")
    return classified(found, fit(found, name), name)
