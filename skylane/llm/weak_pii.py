"""Personal data in texts: fixed patterns, and weakly supervised spans beside them.

Four fixed patterns give the base spans. Further candidates (spelled-out mail addresses, local phone
numbers, national numbers, bank accounts, titled names) come from loose patterns. On every span, base or
candidate, labelers vote: format (a stricter regex), gazetteer (lists of endings, prefixes, names),
context (words just before it) and checksum; a labeler may abstain. Counts of equal vote patterns over
all documents, a table whose size the labelers bound, go to expectation-maximisation, which estimates for
each kind how often a span is personal data and for each labeler how often it is right; a logistic
classifier is then trained on the votes with EM's probabilities as soft labels. It becomes a SQL
expression that accepts or rejects the candidates. Base spans stay whatever it says.

All work on texts is SQL expressions: a pattern's spans follow from the lengths of its matches and of the
parts between them. Texts are read once; spans and votes are kept in a written table.

Defined results: a null text counts as empty and has no spans; rows with null or repeated ids are
answered one by one; an empty table gives no rows, and without candidates the classifier accepts none.
Positions are code points, the end exclusive. A candidate that overlaps a base span is dropped. Other
columns are ignored, whatever their names. Patterns are possessive or bounded, so that matching takes
linear time and no deep stack on any text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.llm.common import let, text_of
from skylane.session import written

LABELERS = ("format", "gazetteer", "context", "checksum")
ROUNDS = 60
ACCEPT = 0.9
CONTEXT_CHARS = 40

# Gazetteers and context words (fixed values).
_ENDINGS = "com|org|net|edu|gov|io|info|biz|de|fr|es|it|uk|eu|ch|at|nl|be|pl|se|us|ca|au|jp|cn|in|br"
_COUNTRIES = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|HU|IE|IT|LU|NL|NO|PL|PT|SE"
_NAMES = (
    "James|John|Robert|Michael|David|William|Mary|Patricia|Jennifer|Linda|Elizabeth|Sarah|Anna|Maria|Peter|Paul|Thomas|"
    "Hans|Klaus|Pierre|Jean|Marie|Sophie|Carlos|Juan|Jose|Luis|Carmen|Laura|Emma|Julia|Daniel|Martin"
)
_CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|address|host|client|server|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact)\b",
    "email_spelled": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "phone_local": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact)\b",
    "national_id": r"(?i)\b(?:ssn|social|security|national|id|identity)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer|konto|compte|cuenta)\b",
    "person": r"(?i)\b(?:name|contact|attention|dear|signed|by)\b",
}


@dataclass(frozen=True)
class Kind:
    """``pattern`` finds spans where ``gate`` (a cheaper test) holds of the text; ``passes`` drops failing ones."""

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    passes: Callable[[Column], Column]
    format: Callable[[Column], Column | None]
    gazetteer: Callable[[Column], Column | None]
    checksum: Callable[[Column], Column | None]
    base: bool = False


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of ``m`` pass the Luhn test."""

    def worth(c: Column, i: Column) -> Column:
        doubled = (F.ascii(c) - 48) * 2
        return F.when(i % 2 == 0, F.ascii(c) - 48).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    # Splitting at the empty pattern may leave an empty string at the end.
    each = F.transform(F.array_remove(F.split(F.reverse(_digits(m)), ""), ""), worth)
    return F.aggregate(each, F.lit(0), lambda s, v: s + v) % 10 == 0


def _iban_checks(m: Column) -> Column:
    """ISO 7064 remainder 97, over the letters as numbers, folded digit by digit."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")

    def fold(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        digit = F.ascii(c) - 48
        return F.when(c == "", rest).when(F.ascii(c) >= 65, (rest * 100 + letter) % 97).otherwise((rest * 10 + digit) % 97)

    return F.aggregate(turned, F.lit(0), fold) == 1


def _none(m: Column) -> None:
    return None


def _has(pattern: str) -> Callable[[Column], Column]:
    return lambda t: t.rlike(pattern)


_IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# A run that cannot match from its start matches from no later place in it; \G lets a match follow another.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"),
        lambda m: F.lit(True),
        _has(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}$"),
        _has(rf"(?i)\.(?:{_ENDINGS})$"),
        _none,
        base=True,
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        _has(r"[0-9]\.[0-9]"),
        _has(rf"^{_IP_PART}\.{_IP_PART}\.{_IP_PART}\.{_IP_PART}$"),
        _has(r"^(?!0\d|127\.|255\.)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"),
        _none,
        _none,
        base=True,
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        _has(r"[0-9](?:[\x20-]?[0-9]){11}"),
        lambda m: F.char_length(_digits(m)).between(12, 19) & luhn(m),
        _has(r"^(?:[0-9]{12,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$"),
        _has(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
        luhn,
        base=True,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        _has(r"\+[0-9]"),
        lambda m: F.char_length(_digits(m)).between(9, 15),
        _has(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,5}){1,4}$"),
        _has(r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"),
        _none,
        base=True,
    ),
    Kind(
        "email_spelled",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}"
        r"(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{2,24}){1,4}",
        lambda t: t.rlike(r"[(\[]at[)\]]|[(\[ ]dot[)\] ]"),
        lambda m: F.lit(True),
        _has(r"(?:\(at\)|\[at\]).*(?:\(dot\)|\[dot\]|\.)| at \S+ dot "),
        _has(rf"(?i)(?:\)|\]|\x20|\.)(?:{_ENDINGS})$"),
        _none,
    ),
    Kind(
        "phone_local",
        r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
        _has(r"[0-9]{3}[\x20.-][0-9]{4}"),
        lambda m: F.lit(True),
        _has(r"^\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[.-][0-9]{4}$"),
        _none,
        _none,
    ),
    Kind(
        "national_id",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        _has(r"[0-9]-[0-9]{2}-[0-9]"),
        lambda m: F.lit(True),
        _has(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"),
        _none,
        _none,
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        _has(r"[A-Z]{2}[0-9]{2}"),
        lambda m: F.lit(True),
        lambda m: F.char_length(F.regexp_replace(m, " ", "")).between(15, 34),
        _has(rf"^(?:{_COUNTRIES})"),
        _iban_checks,
    ),
    Kind(
        "person",
        r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30}){0,2}",
        _has(r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20\p{Lu}"),
        lambda m: F.lit(True),
        _has(r"^\S+\x20\S+\x20\S+"),
        _has(rf"\x20(?:{_NAMES})(?:\x20|$)"),
        _none,
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)
# Sorted spans are in order of their starts, then of their kinds as listed.
_SPAN = "struct<start:int,rank:int,end:int,kind:string,votes:string>"


def _vote(test: Column | None) -> Column:
    return F.lit("-") if test is None else F.when(test, "1").otherwise("0")


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """The kind's spans in the text with their votes, one character per labeler, '-' where it abstains."""
    step = "struct<at:int,spans:array<" + _SPAN + ">>"

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["match"])
        before = F.right(x["gap"], F.lit(CONTEXT_CHARS))
        votes = F.concat(
            _vote(kind.format(x["match"])),
            _vote(kind.gazetteer(x["match"])),
            # No word before it says nothing against a span.
            F.when(before.rlike(_CONTEXT[kind.name]), "1").otherwise("-"),
            _vote(kind.checksum(x["match"])),
        )
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), votes.alias("votes"))
        spans = F.when(kind.passes(x["match"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        moved = F.struct(end.alias("at"), spans.alias("spans")).cast(step)
        return F.when(x["match"].isNull(), acc).otherwise(moved)

    def found(matches: Column) -> Column:
        parts = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), matches.alias("match"))
        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans")).cast(step)
        return F.aggregate(parts, first, add, lambda acc: acc["spans"])

    nothing = F.array().cast(f"array<{_SPAN}>")
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    there = let(matches, lambda m: F.when(F.size(m) > 0, found(m)).otherwise(nothing))
    return F.when(kind.gate(text), there).otherwise(nothing)


def rendered(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and candidate spans with votes; a written table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    each = [spans_of(F.col("text"), k, i) for i, k in enumerate(KINDS)]
    base = F.sort_array(F.concat(*[s for s, k in zip(each, KINDS) if k.base]))
    more = F.sort_array(F.concat(*[s for s, k in zip(each, KINDS) if not k.base]))
    table = written(rows.select("doc_id", base.alias("base"), more.alias("more")), "spans")
    clear = F.filter("more", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return table.select("doc_id", "base", clear.alias("more"))


@dataclass(frozen=True)
class SpanClassifier:
    """Log-odds: a bias per kind and a weight per labeler, added for its yes and subtracted for its no."""

    bias: dict[str, float]
    weights: tuple[float, ...]

    def score(self, kind: str, votes: str) -> float:
        return self.bias.get(kind, -math.inf) + sum(w * _SIGN[v] for w, v in zip(self.weights, votes))

    def accepts(self, span: Column) -> Column:
        bias = F.lit(None).cast("double")
        for kind, b in self.bias.items():
            bias = F.when(span["kind"] == kind, F.lit(b)).otherwise(bias)
        total = bias
        for i, w in enumerate(self.weights):
            vote = F.substring(span["votes"], i + 1, 1)
            total = total + F.when(vote == "1", F.lit(w)).when(vote == "0", F.lit(-w)).otherwise(0.0)
        return F.coalesce(total >= F.lit(math.log(ACCEPT / (1 - ACCEPT))), F.lit(False))


_SIGN = {"1": 1.0, "0": -1.0, "-": 0.0}
Patterns = list[tuple[str, str, int]]


def vote_patterns(found: DataFrame) -> Patterns:
    """(kind, votes, spans) over all documents: at most kinds x 3^labelers rows."""
    spans = found.select(F.explode(F.concat("base", "more")).alias("s"))
    rows = spans.groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes").collect()
    return [(r["kind"], r["votes"], r["n"]) for r in rows]


def estimate(patterns: Patterns) -> dict[tuple[str, str], float]:
    """EM: the probability that spans of each (kind, votes) are personal data.

    Each labeler has a rate of yes among true spans and one among false ones, shared by the kinds and
    held by weak counts; each kind has its own share of true spans.
    """
    kinds = sorted({k for k, _, _ in patterns})
    share = {k: 0.5 for k in kinds}
    yes = {True: [0.8] * len(LABELERS), False: [0.2] * len(LABELERS)}
    belief: dict[tuple[str, str], float] = {}
    for _ in range(ROUNDS):
        for kind, votes, _ in patterns:
            odds = math.log(share[kind] / (1 - share[kind]))
            for i, v in enumerate(votes):
                if v != "-":
                    a, b = yes[True][i], yes[False][i]
                    odds += math.log(a / b) if v == "1" else math.log((1 - a) / (1 - b))
            belief[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for kind in kinds:
            own = [(belief[k, v], n) for k, v, n in patterns if k == kind]
            share[kind] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        for true in (True, False):
            for i in range(len(LABELERS)):
                cast = [((belief[k, v] if true else 1 - belief[k, v]) * n, v[i]) for k, v, n in patterns if v[i] != "-"]
                said = sum(w for w, v in cast if v == "1")
                weak = 8.0 if true else 2.0
                yes[true][i] = (weak + said) / (10 + sum(w for w, _ in cast))
    return belief


def train(patterns: Patterns) -> SpanClassifier:
    """A logistic classifier on the votes, fitted to EM's probabilities."""
    belief = estimate(patterns)
    kinds = sorted({k for k, _, _ in patterns})
    total = sum(n for _, _, n in patterns) or 1
    bias, weights = {k: 0.0 for k in kinds}, [0.0] * len(LABELERS)
    for _ in range(2000):
        slope_b, slope_w = {k: 0.0 for k in kinds}, [0.01 * w for w in weights]
        for kind, votes, n in patterns:
            score = bias[kind] + sum(w * _SIGN[v] for w, v in zip(weights, votes))
            off = (1 / (1 + math.exp(-max(-30.0, min(30.0, score)))) - belief[kind, votes]) * n / total
            slope_b[kind] += off
            for i, v in enumerate(votes):
                slope_w[i] += off * _SIGN[v]
        bias = {k: b - slope_b[k] for k, b in bias.items()}
        weights = [w - g for w, g in zip(weights, slope_w)]
    return SpanClassifier(bias, tuple(weights))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    found = find(docs)
    classifier = train(vote_patterns(found))
    added = F.filter("more", classifier.accepts)
    rows = found.select("doc_id", "base", added.alias("added"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(rendered(F.col("base")), 256).alias("base_sha256"),
        rendered(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
