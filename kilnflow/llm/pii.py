"""Personal data by weak supervision, in built-in functions only.

Patterns find candidate spans. Labelers vote on each (1, -1, or 0 for no opinion): the form
the regex asks for, gazetteers of endings, prefixes and codes, cue words in the text before,
the characters next to it, and its grouping. Votes are counted by pattern over all
documents; expectation-maximisation on those counts estimates how reliable each labeler is
for each kind, and a span classifier is trained on the labels it infers. What the base rules
accept stays; the classifier adds spans that do not overlap them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnflow.llm.common import documents, let

# --- Fixed values -------------------------------------------------------------------------

#: Order of the kinds in results; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "local_phone", "spelled_email", "secret")
BASE = KINDS[:4]

#: Greedy where the base rule is; possessive groups and the look-behinds change no match, and
#: keep long runs from being tried again at each of their characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9])\([0-9]{3}\)\x20?[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    "spelled_email": r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,}",
    # Keys, tokens and passwords of machines: long runs with letters and digits.
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,512}+(?![A-Za-z0-9+/_=-])",
}
#: What a text must have for its pattern to match: cheaper to look for.
NEEDS = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": "+", "ssn": r"[0-9]-[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9]", "local_phone": r"\([0-9]", "spelled_email": r"[\[(]at[\])]",
    "secret": r"[A-Za-z0-9+/_=-]{20}",
}
#: Forms that make a match sound; for cards and phones the digits decide.
FORMS = {
    "email": r"\.[A-Za-z]{2,24}$",
    "ip": r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{11,38}$",
    "local_phone": r"^\([2-9]",
    "spelled_email": r"[A-Za-z]{2,}$",
    "secret": r"[0-9].*[0-9].*[0-9].*[0-9]",
}
#: Endings, prefixes and codes in use.
GAZETTEERS = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|biz|de|fr|es|it|uk|eu|us|ca|au|ch|at|nl|be|pl|br|in|jp|cn|ru)$",
    "ip": r"^(?!0+\.)(?!22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6[0245])",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "ssn": r"^[0-8]",
    "iban": r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|IE|IT|LU|NL|NO|PL|PT|SE)",
    "local_phone": r"^\([2-9][0-8][0-9]\)",
    "spelled_email": r"(?i:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us)$",
    "secret": r"^(?:AKIA|ASIA|AIza|ya29|gh[opsur]_|github_pat_|glpat-|hf_|npm_|pk_|rk_|sk[_-]|xox[abprs]-|eyJ)|^[0-9a-fA-F]{32,128}$",
}
#: Words before a span that speak for its kind.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt)\W{0,3}(?:\w+\W+)?$",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|client|login)\W{0,3}(?:\w+\W+)?$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\W{0,3}(?:\w+\W+)?$",
    "phone": r"(?i)\b(?:phone|tel|telefon|téléphone|teléfono|call|mobile|cell|fax)\W{0,3}(?:\w+\W+)?$",
    "ssn": r"(?i)\b(?:ssn|social|security)\W{0,3}(?:\w+\W+)?$",
    "iban": r"(?i)\b(?:iban|account|konto|compte|cuenta)\W{0,3}(?:\w+\W+)?$",
    "local_phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax)\W{0,3}(?:\w+\W+)?$",
    "spelled_email": r"(?i)\b(?:e-?mail|mail|contact|write)\W{0,3}(?:\w+\W+)?$",
    "secret": r"(?i)(?:token|secret|passwor[dt]|passwd|pwd|api.?key|(?:access|private|signing).?key|bearer|authorization|credential|jeton|clave|contraseña|kennwort)s?[\"'\x20]{0,2}(?:[:=]|=>)?\x20{0,2}[\"']?$",
}
#: Text right before a span that speaks against its kind: keys, versions, numbers of things;
#: for keys and the like, digests and addresses.
NOT_SECRET = r"(?i)(?:\b(?:sha-?[0-9]*|md5|hash|digest|checksum|commit|uuid|etag|isbn|href|src)\W{0,4}|[#/\\.])$"
AGAINST = r"(?i)(?:\b(?:version|release|isbn|token|key|hash|sha|md5|order|page|section)\W{0,4}|[=#/\\]\W?)$"
#: Sound grouping of what has one.
GROUPS = {
    "card": r"^(?:[0-9]+|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$",
    "phone": r"^\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,5})){1,6}$",
    "iban": r"^(?:[A-Z0-9]+|[A-Z0-9]{4}(?:\x20[A-Z0-9]{4})+(?:\x20[A-Z0-9]{1,3})?)$",
    "secret": r"^(?:[A-Z]{4}|[a-z]+[_-])?(?:[0-9a-f]+|[0-9A-F]+|[A-Za-z0-9+/]+={0,2}|[A-Za-z0-9_-]+)$",
}
LABELERS = ("form", "gazetteer", "context", "edges", "grouping")

# --- Parameters ---------------------------------------------------------------------------

#: Code points of context before a span.
CONTEXT = 40
#: Posterior from which the classifier adds a span.
ACCEPT = 0.9
EM_ROUNDS = 25
TRAIN_ROUNDS = 300


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _prefix_sums(steps: Column) -> Column:
    """Sums of all earlier elements, by runs of 64, so that long arrays stay affordable."""
    run = 64

    def of(s: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), ((F.size(s) - 1) / run).cast("int")),
            lambda b: _total(F.slice(s, b * run + 1, F.lit(run))),
        )

        def starts(r: Column) -> Column:
            before = F.transform(r, lambda _, b: _total(F.slice(r, F.lit(1), b)))
            return let(
                before,
                lambda t: F.transform(
                    s,
                    lambda _, i: F.get(t, (i / run).cast("int"))
                    + _total(F.slice(s, (i / run).cast("int") * run + 1, i % run)),
                ),
            )

        return let(runs, starts)

    return F.when(F.size(steps) > 0, let(steps, of)).otherwise(F.array().cast("array<int>"))


def find_all(text: Column, pattern: str) -> Column:
    """All matches: ``start`` and ``end`` in code points, ``value``, and the text on both sides."""
    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
    )

    def spans(p: Column) -> Column:
        steps = F.transform(p["hits"], lambda h, i: F.length(h) + F.length(F.get(p["gaps"], i)))

        def span(s: Column) -> Column:
            def one(h: Column, i: Column) -> Column:
                gap = F.get(p["gaps"], i)
                start = F.get(s, i) + F.length(gap)
                return F.struct(
                    start.alias("start"),
                    (start + F.length(h)).alias("end"),
                    h.alias("value"),
                    F.right(gap, F.lit(CONTEXT)).alias("left"),
                    F.left(F.get(p["gaps"], i + 1), F.lit(1)).alias("right"),
                )

            return F.transform(p["hits"], one)

        return let(_prefix_sums(steps), span)

    return let(parts, spans)


_SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
_CANDIDATE = "array<struct<kind:int,start:int,end:int,base:boolean,votes:array<int>>>"


def luhn(digits: Column) -> Column:
    """Whether the check digit holds; digits as text."""
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _sound(kind: str, value: Column) -> Column:
    """Whether a match keeps its kind's rule."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "email":
        return F.lit(True)
    return value.rlike(FORMS[kind])


def _vote(yes: Column, no: Column | None = None) -> Column:
    against = F.lit(-1) if no is None else F.when(no, -1).otherwise(0)
    return F.when(yes, 1).otherwise(against)


def _candidates(kind: str, text: Column) -> Column:
    need = NEEDS[kind]
    there = text.contains(need) if kind in ("email", "phone") else text.rlike(need)

    def judge(s: Column) -> Column:
        form = s["value"].rlike(FORMS["email"]) if kind == "email" else _sound(kind, s["value"])
        before = F.right(s["left"], F.lit(1))
        if kind == "secret":
            edges = _vote(before.rlike("[\"'`:=]") & s["right"].rlike("[\"'`;,]"))
        else:
            edges = _vote(~before.rlike("[A-Za-z0-9]") & ~s["right"].rlike("[A-Za-z0-9]"))
        votes = [
            _vote(form),
            _vote(s["value"].rlike(GAZETTEERS[kind])),
            _vote(s["left"].rlike(CUES[kind]), s["left"].rlike(NOT_SECRET if kind == "secret" else AGAINST)),
            edges,
            _vote(s["value"].rlike(GROUPS[kind])) if kind in GROUPS else F.lit(0),
        ]
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            (_sound(kind, s["value"]) if kind in BASE else F.lit(False)).alias("base"),
            F.array(*votes).alias("votes"),
        )

    found = find_all(text, PATTERNS[kind]).cast(_SPAN)
    if kind == "card":  # shorter and longer numbers can't be cards
        found = F.filter(found, lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", "")).between(12, 19))
    return F.when(there, F.transform(found, judge)).otherwise(F.array().cast(_CANDIDATE))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the ``spans`` of every text that any pattern finds, with their votes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.concat(*(_candidates(k, text) for k in KINDS)).alias("spans"),
    )


@dataclass(frozen=True)
class SpanClassifier:
    """Log-odds of a span: a bias for its kind and a weight for each labeler's vote."""

    bias: tuple[float, ...]
    weights: tuple[float, ...]

    def probability(self, kind: Column, votes: Column) -> Column:
        total = F.element_at(F.array(*map(F.lit, self.bias)), kind + 1)
        for i, w in enumerate(self.weights):
            total = total + F.get(votes, F.lit(i)) * w
        return 1 / (1 + F.exp(-total))


Patterns = list[tuple[int, tuple[int, ...], int]]


def reliabilities(patterns: Patterns) -> tuple[dict[int, float], dict[tuple[int, int], tuple[float, float]]]:
    """Expectation-maximisation over vote patterns (kind, votes, count).

    Gives each kind's share of true spans, and for each kind and labeler the chance of a vote
    for a true span and for a false one, given that it votes. Smoothed; starts from labelers
    that are right four times in five.
    """
    kinds = {k for k, _, _ in patterns}
    prior = {k: 0.5 for k in kinds}
    chance = {(k, i): (0.8, 0.2) for k in kinds for i in range(len(LABELERS))}
    for _ in range(EM_ROUNDS):
        truth = [posterior(prior, chance, k, v) for k, v, _ in patterns]
        for k in kinds:
            mine = [(t, n) for t, (kk, _, n) in zip(truth, patterns) if kk == k]
            prior[k] = (sum(t * n for t, n in mine) + 1) / (sum(n for _, n in mine) + 2)
        for k, i in chance:
            true_for = true_all = false_for = false_all = 0.0
            for t, (kk, votes, n) in zip(truth, patterns):
                if kk == k and votes[i]:
                    true_all += t * n
                    false_all += (1 - t) * n
                    true_for += t * n * (votes[i] > 0)
                    false_for += (1 - t) * n * (votes[i] > 0)
            chance[k, i] = (true_for + 4) / (true_all + 5), (false_for + 1) / (false_all + 5)
    return prior, chance


def posterior(prior, chance, kind: int, votes: tuple[int, ...]) -> float:
    odds = math.log(prior[kind] / (1 - prior[kind]))
    for i, v in enumerate(votes):
        for_true, for_false = chance[kind, i]
        if v > 0:
            odds += math.log(for_true / for_false)
        elif v < 0:
            odds += math.log((1 - for_true) / (1 - for_false))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def train(patterns: Patterns) -> SpanClassifier:
    """Logistic regression on the labels that the estimated reliabilities infer."""
    bias, weights = [0.0] * len(KINDS), [0.0] * len(LABELERS)
    if not patterns:
        return SpanClassifier(tuple(bias), tuple(weights))
    prior, chance = reliabilities(patterns)
    # Frequent patterns weigh by the logarithm of their count, so that rare kinds count too.
    rows = [(k, v, posterior(prior, chance, k, v), math.log1p(n)) for k, v, n in patterns]
    total = sum(w for *_, w in rows)
    for _ in range(TRAIN_ROUNDS):
        slope_b, slope_w = [0.0] * len(KINDS), [1e-3 * w for w in weights]
        for k, votes, target, share in rows:
            z = bias[k] + sum(w * v for w, v in zip(weights, votes))
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - target) * share / total
            slope_b[k] += error
            for i, v in enumerate(votes):
                slope_w[i] += error * v
        bias = [b - 2 * s for b, s in zip(bias, slope_b)]
        weights = [w - 2 * s for w, s in zip(weights, slope_w)]
    return SpanClassifier(tuple(bias), tuple(weights))


def vote_patterns(found: DataFrame) -> Patterns:
    """How often each kind got each combination of votes: at most 9 x 3^5 rows."""
    base = 3 ** len(LABELERS)

    def code(s: Column) -> Column:
        digits = F.transform(s["votes"], lambda v, i: (v + 1) * F.pow(F.lit(3), i).cast("int"))
        return s["kind"] * base + _total(digits)

    # One number per span: exploding the spans themselves would find them once for each field.
    # The outer explode, because the plain one first tests the array, and finds it twice.
    codes = found.select(F.explode_outer(F.transform("spans", code)).alias("code"))
    counts = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("code is not null")
    return sorted(
        (r.code // base, tuple(r.code % base // 3**i % 3 - 1 for i in range(len(LABELERS))), r.n)
        for r in counts.collect()
    )


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """The personal data of every whole text.

    ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``, and
    ``n_added``. Null counts as empty: zeros, an empty list and its digest. Rows are
    independent of each other but for the counts of votes; nothing is shuffled but those.
    """
    found = candidates(docs)
    model = train(vote_patterns(found))

    def added(s: Column) -> Column:
        return ~s["base"] & (model.probability(s["kind"], s["votes"]) >= ACCEPT)

    sorted_out = found.select(
        "doc_id",
        F.filter("spans", lambda s: s["base"]).alias("base"),
        F.filter("spans", added).alias("more"),
    )
    clear = F.filter(
        "more",
        lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"])),
    )
    whole = sorted_out.select("doc_id", "base", F.when(F.size("more") > 0, clear).otherwise(F.col("more")).alias("more"))
    ordered = F.array_sort(F.concat("base", "more"))
    return whole.select(
        "doc_id",
        *(
            F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}")
            for k, name in enumerate(BASE)
        ),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        F.when(F.size("more") > 0, _listed(ordered)).otherwise(_listed(F.col("base"))).alias("spans"),
        F.size("more").cast("long").alias("n_added"),
    )


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))
