"""Personal data by weak supervision, in column expressions.

Base patterns and looser ones propose spans.  Labelers vote on each: the form of the
match, its checksum or range, gazetteers, words before it that speak for and against.
Expectation-maximisation over the counts of vote patterns, a table whose size depends on
the labelers alone, estimates how reliable each labeler is and how likely each pattern
marks personal data.  A span classifier over features of span and context is trained
with these likelihoods; it decides about the looser spans.  Base spans always stay.

Everything that touches rows is a DataFrame expression.  The driver sees the counts of
vote patterns and of feature values only.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.functions.text import let
from loomsift.llm.common import doc_texts, documents, written

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "hidden_email", "local_phone", "ssn", "iban", "name")

# The base patterns in forms that never go back over a run: possessive loops, and starts
# only where a run starts or the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A character without which a text has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}

GIVEN_NAMES = ("James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica "
               "Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Mark Paul Steven Andrew Emily Peter Anna Maria Laura "
               "Hans Klaus Jürgen Wolfgang Monika Petra Sabine Ursula Pierre Jean Michel Jacques Marie Nathalie Isabelle François "
               "José Juan Carlos Luis Carmen Isabel Ana Antonio Francisco").split()
_NAME = r"(?:" + "|".join(GIVEN_NAMES) + r") \p{Lu}[\p{L}'’-]{1,30}+"
_LOCAL = r"\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![ .-]?[0-9])(?![\p{L}])"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])"
_HIDDEN = r"[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]++)++"
LOOSE = (rf"(?<![\p{{L}}0-9@.+-])(?<!\+[0-9]{{1,3}}[ (]{{1,2}})(?<![0-9][ .-])(?:(?=[0-9]{{3}}-){_SSN}|(?=[(0-9]){_LOCAL}|(?=[A-Z]{{2}}[0-9]){_IBAN}"
         rf"|(?=\p{{Lu}}){_NAME}|{_HIDDEN})")
LOOSE_HINTS = r"[0-9][ .-][0-9]|[A-Z]{2}[0-9]{2}|[\[(]at[\])]|\b(?=\p{Lu})(?:" + "|".join(GIVEN_NAMES) + ") "
SHAPES = {"hidden_email": r"[\[(]at[\])]", "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "local_phone": r"^[(0-9]", "iban": r"^[A-Z]{2}[0-9]{2}"}

CUES = r"\b(call|phone|tel|telefon|mobile|fax|contact|email|mail|e-mail|ssn|social|iban|account|konto|name|mr|mrs|ms|dr|herr|frau|card|visa|address|ip|host|reach)\b"
AGAINST = r"\b(version|isbn|issn|page|pages|figure|fig|chapter|order|invoice|serial|model|part|room|volume|section|release)\b"
ENDINGS = r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us|example)$"
LABELERS = ("form", "check", "gazetteer", "cue", "against")
CONTEXT = 40
ROUNDS = 40
BLOCK = 256


# --- spans ---------------------------------------------------------------------

def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _placed(found: Column, gaps: Column) -> Column:
    """start, end, match and context of the matches between these gaps.

    Running sums go block by block, so a text with very many matches stays cheap.
    """
    def starts(sizes: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK)), lambda b: _total(F.slice(sizes, (b * BLOCK + 1).cast("int"), BLOCK)))

        def with_blocks(sums: Column) -> Column:
            before = F.transform(sums, lambda x, b: _total(F.slice(sums, F.lit(1), b)))
            return let(before, lambda first: F.transform(found, lambda m, i: let(
                F.get(first, F.floor(i / BLOCK).cast("int")) + _total(F.slice(sizes, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), i % BLOCK))
                + F.char_length(F.get(gaps, i)),
                lambda s: F.struct(s.alias("s"), (s + F.char_length(m)).alias("e"), m.alias("m"),
                                   F.lower(F.right(F.get(gaps, i), F.lit(CONTEXT))).alias("left"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("next")))))

        return let(blocks, with_blocks)

    sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.char_length(g) + F.char_length(m)).cast("long"))
    return let(sizes, starts)


MATCH = "array<struct<s:bigint,e:bigint,m:string,left:string,next:string>>"


def located(text: Column, pattern: str, possible: Column | None = None) -> Column:
    """All matches with code-point offsets, leftmost and non-overlapping."""
    none = F.array().cast(MATCH)
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(
        let(F.split(text, pattern, -1), lambda g: _placed(m, g))))
    return found if possible is None else F.when(possible, found).otherwise(none)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The Luhn check of a string of digits: every second digit from the right counts as the digit sum of its double."""
    doubled = F.translate(F.reverse(number), "0123456789", "0246813579")
    return let(F.struct(F.split(F.reverse(number), "").alias("a"), F.split(doubled, "").alias("b")), lambda x: F.aggregate(
        F.sequence(F.lit(1), F.size(x["a"])), F.lit(0),
        lambda t, i: t + F.when(i % 2 == 1, F.element_at(x["a"], i)).otherwise(F.element_at(x["b"], i)).cast("int"))) % 10 == 0


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda m: luhn(digits(m)),
    "phone": lambda m: F.char_length(digits(m)).between(9, 15),
}


# --- labelers ------------------------------------------------------------------

def _vote(plus: Column, minus: Column) -> Column:
    return F.when(plus, "+").when(minus, "-").otherwise("0")


def _votes(kind: Column, m: Column, left: Column, after: Column) -> Column:
    """One sign for each labeler, after the kind: the vote pattern."""
    n = F.char_length(digits(m))
    form = F.when(kind.isin("email", "hidden_email"), _vote(m.rlike(r"^[A-Za-z0-9].*[A-Za-z]{2,}$"), m.rlike(r"\.\.|^[._%+-]"))) \
        .when(kind.isin("phone", "local_phone"), _vote(n.between(9, 13), (n < 8) | (n > 14))) \
        .when(kind == "name", _vote(after.rlike("^[ ,.;:!?]") | (after == ""), after.rlike("^[0-9_]"))) \
        .otherwise(_vote(after.rlike(r"^[\s,.;:!?)]") | (after == ""), after.rlike("^[A-Za-z0-9_/]")))
    check = F.when(kind == "card", _vote(luhn(digits(m)), ~luhn(digits(m)))) \
        .when(kind == "ip", _vote(~m.rlike(r"^(0|10|127|192\.168|255)\."), m.rlike(r"^(0|127|255)\."))) \
        .when(kind == "ssn", _vote(~m.rlike(r"^(000|666|9)|-00-|-0000$"), m.rlike(r"^(000|666|9)|-00-|-0000$"))) \
        .when(kind.isin("phone", "local_phone"), _vote(F.lit(False), digits(m).rlike(r"^([0-9])\1*$"))) \
        .when(kind == "iban", _vote(F.char_length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34), F.lit(True))).otherwise("0")
    gazetteer = F.when(kind.isin("email", "hidden_email"), _vote(m.rlike(ENDINGS), F.lit(False))) \
        .when(kind == "iban", _vote(m.rlike("^(AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"), F.lit(True))) \
        .when(kind == "name", _vote(left.rlike(r"\b(mr|mrs|ms|dr|herr|frau|prof)\.? $"), left.rlike(r"\b(saint|san|santa|st)\.? $"))).otherwise("0")
    return F.concat(kind, F.lit("|"), form, check, gazetteer, _vote(left.rlike(CUES), F.lit(False)), _vote(F.lit(False), left.rlike(AGAINST)))


def _features(kind: Column, m: Column, left: Column, after: Column) -> Column:
    """Values of a bounded set each: kind, length, digits, separators, cue and counter word, what follows."""
    cue, against = F.regexp_extract(left, CUES, 1), F.regexp_extract(left, AGAINST, 1)
    return F.array(
        F.concat(F.lit("kind="), kind),
        F.concat(F.lit("len="), kind, F.lit(","), F.least(F.floor(F.char_length(m) / 4), F.lit(10)).cast("string")),
        F.concat(F.lit("digits="), F.least(F.char_length(digits(m)), F.lit(20)).cast("string")),
        F.concat(F.lit("marks="), F.when(m.contains("("), "(").when(m.contains("-"), "-").when(m.contains(" "), " ").when(m.contains("."), ".").otherwise("")),
        F.concat(F.lit("cue="), cue), F.concat(F.lit("against="), against),
        F.concat(F.lit("next="), F.when(after == "", "end").when(after.rlike(r"\s"), "blank").when(after.rlike("[A-Za-z0-9]"), "word").otherwise("mark")))


def _loose_kind(m: Column) -> Column:
    kind = F.lit("name")
    for name in ("iban", "local_phone", "ssn", "hidden_email"):
        kind = F.when(m.rlike(SHAPES[name]), name).otherwise(kind)
    return kind


def _candidates(matches: Column, kind: Column | None, base: bool) -> Column:
    def one(x: Column) -> Column:
        return let(kind if kind is not None else _loose_kind(x["m"]), lambda k: F.struct(
            k.alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(base).alias("base"),
            _votes(k, x["m"], x["left"], x["next"]).alias("votes"), _features(k, x["m"], x["left"], x["next"]).alias("features")))
    return F.transform(matches, one)


def proposed(docs: DataFrame) -> DataFrame:
    """doc_id and all candidate spans (kind, s, e, base, votes, features) of every document."""
    text = F.col("text")

    def base(kind: str) -> Column:
        matches = located(text, BASE[kind], text.contains(NEEDS[kind]) if kind in NEEDS else None)
        return _candidates(F.filter(matches, lambda x: VALID[kind](x["m"])), F.lit(kind), True)

    parts = [base(k) for k in BASE_KINDS]
    parts.append(_candidates(located(text, LOOSE, text.rlike(LOOSE_HINTS)), None, False))
    return doc_texts(docs).select("doc_id", F.concat(*parts).alias("spans"))


# --- estimates -----------------------------------------------------------------

def estimate(counts: dict[str, int], rounds: int = ROUNDS) -> tuple[dict[str, float], dict[str, dict[str, tuple[float, float]]]]:
    """Likelihood of each vote pattern and, for each labeler and vote, its share among true and false spans."""
    belief = {}
    for pattern in counts:
        votes = pattern.rpartition("|")[2]
        score = votes.count("+") - votes.count("-")
        belief[pattern] = 1 / (1 + math.exp(-1.5 * score))
    shares: dict[str, dict[str, tuple[float, float]]] = {}
    for _ in range(rounds):
        # Shares of each vote and of each kind among true and false spans, with one imagined span each way.
        seen = [{v: [1.0, 1.0] for v in "+-0"} for _ in LABELERS]
        kinds: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
        for pattern, n in counts.items():
            kind, _, votes = pattern.rpartition("|")
            p = belief[pattern]
            kinds[kind][0] += n * p
            kinds[kind][1] += n * (1 - p)
            for j, v in enumerate(votes):
                seen[j][v][0] += n * p
                seen[j][v][1] += n * (1 - p)
        totals = [[sum(c[y] for c in s.values()) for y in (0, 1)] for s in seen]
        shares = {LABELERS[j]: {v: (c[0] / totals[j][0], c[1] / totals[j][1]) for v, c in s.items()} for j, s in enumerate(seen)}
        for pattern in counts:
            kind, _, votes = pattern.rpartition("|")
            log = math.log(kinds[kind][0] / kinds[kind][1])
            for j, v in enumerate(votes):
                a, b = shares[LABELERS[j]][v]
                log += math.log(a / b)
            belief[pattern] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
    return belief, shares


def _mapped(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in sorted(values.items()) for x in kv)) if values else F.create_map().cast("map<string,double>")


def classifier(spans: DataFrame) -> tuple[float, dict[str, float]]:
    """Prior and weights (log odds) of the span classifier, trained on the voters' likelihoods.

    ``spans`` has one row per candidate with ``votes`` and ``features``.
    """
    counts = {r.votes: r.n for r in spans.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    belief, _ = estimate(counts)
    p = F.element_at(_mapped(belief), F.col("votes"))
    rows = (spans.select(F.explode("features").alias("feature"), p.alias("p")).groupBy("feature")
            .agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect())
    yes = sum(n * belief[v] for v, n in counts.items()) + 1
    no = sum(n * (1 - belief[v]) for v, n in counts.items()) + 1
    return math.log(yes / no), {r.feature: math.log((r.yes + 0.5) / (yes + 1)) - math.log((r.no + 0.5) / (no + 1)) for r in rows}


def find_personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Per document: counts of base kinds, digest of the base spans and all spans.

    Looser spans are reported where the classifier gives them at least ``least``.
    Offsets are code points.  A null text is empty; null doc_ids and repeated rows keep
    their rows.  Without any candidate only the empty digest comes out.
    """
    found = written(proposed(docs), "personal-data")
    prior, weights = classifier(found.select(F.explode("spans").alias("x")).select("x.votes", "x.features"))
    table = _mapped(weights)

    def score(x: Column) -> Column:
        return F.aggregate(x["features"], F.lit(prior), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0)))

    cut = math.log(least / (1 - least))
    spans = F.col("spans")
    kept = F.filter(spans, lambda x: x["base"] | (score(x) >= cut)) if weights else spans

    def text_of(some: Column) -> Column:
        return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")

    base = F.filter(spans, lambda x: x["base"])

    def of_kind(some: Column, kind: str) -> Column:
        return F.filter(some, lambda x: x["kind"] == kind)

    ordered = let(kept, lambda k: F.concat(*(of_kind(k, n) for n in KINDS)))
    counts = [F.size(of_kind(base, n)).cast("long").alias(f"n_{n}") for n in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(text_of(base), 256).alias("base_sha256"), text_of(ordered).alias("spans"))


def op6_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))
