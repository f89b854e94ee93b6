"""Secrets in texts: fixed patterns, and windows of high Shannon entropy per character class.

Candidate strings are runs of at least ``WINDOW`` characters of ``[A-Za-z0-9+/_=-]``. For each class of
characters the stretches of a candidate that lie inside the class are walked by a window of ``WINDOW``
characters; its entropy is kept by adding and removing one count at a time, since
H = log2(w) - sum(c log2 c) / w. Windows at or above the class's threshold are merged into spans. Spans
that look like known harmless strings are suppressed: words (no digit, or almost none), numbers, sequences
of the alphabet, identifiers such as UUIDs, and paths. Where a span is suppressed, what is left of it beside
its words and sequences is judged again by itself, so that a key does not go with harmless text around it.
Spans that a fixed pattern has found already are not reported twice.

Defined results: a null text counts as empty and has no spans; rows with null or repeated ids are
answered one by one; an empty table gives no rows. Positions are code points, the end exclusive. Other
columns are ignored, whatever their names. Texts are handled one at a time, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylane.llm import word_pieces

WINDOW = 20
# Least entropy in bits of a window, by class; a class is tried after the narrower ones before it.
CLASSES: dict[str, tuple[frozenset[str], float]] = {
    "entropy_hex": (frozenset("0123456789abcdef"), 2.8),
    "entropy_upper": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 3.4),
    "entropy_mixed": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 3.6),
}
# The fixed patterns: kind, pattern, least length, the group whose length counts (fixed values).
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_BASE_KINDS = ("assign", "access", "hex")
_ALLOWED = [
    re.compile(r"[0-9]+(?:[-_/][0-9]+)*"),  # numbers and dates
    re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),  # UUIDs
    re.compile(r"(?:/[A-Za-z0-9_.-]{1,15}){2,}/?"),  # paths of short parts
]
_SEQUENCES = ("abcdefghijklmnopqrstuvwxyz", "0123456789")
_IN_SEQUENCE = re.compile(f"(?i)(?=(?:{'|'.join(s[i : i + 8] for s in _SEQUENCES for i in range(len(s) - 7))}))")
_SEPARATORS = "/_=+-"
_PIECE = re.compile(r"[A-Za-z0-9]+")
_CAMEL = re.compile(r"(?:[A-Z]?[a-z]{2,})+")
# Neighbouring words are harmless from so many characters on; shorter ones may be parts of a key with separators.
WORDS_FROM = 8
_SHARE = [0.0] + [n * log2(n) for n in range(1, WINDOW + 1)]


def hot_windows(text: str, letters: frozenset[str], least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged spans of the windows inside ``letters`` whose entropy is at least ``least``."""
    share = _SHARE if window == WINDOW else [0.0] + [n * log2(n) for n in range(1, window + 1)]
    most = (log2(window) - least) * window + 1e-9  # the largest sum(c log2 c) that is still enough
    spans: list[tuple[int, int]] = []
    counts: dict[str, int] = {}
    begin, held = 0, 0.0
    for i, c in enumerate(text):
        if c not in letters:
            counts, begin, held = {}, i + 1, 0.0
            continue
        if i - begin >= window:
            gone = text[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            held += share[n - 1] - share[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        held += share[n + 1] - share[n]
        if i - begin >= window - 1 and held <= most:
            at = i - window + 1
            if spans and at <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((at, i + 1))
    return spans


def _shares(found: str) -> tuple[int, int]:
    """How many digits the string has, and how many changes between upper and lower case."""
    digits = sum(c.isdigit() for c in found)
    return digits, sum(a.isupper() != b.isupper() for a, b in zip(found, found[1:]) if a.isalpha() and b.isalpha())


def allowed(found: str) -> bool:
    """Whether the string is on the allow-list."""
    digits, turns = _shares(found)
    if digits in (0, len(found)) or (digits * 10 < len(found) and turns * 5 < len(found)):
        return True  # words, with a few digits at most, or a number
    lower = found.lower()
    if any(lower[i : i + 8] in s for s in _SEQUENCES for i in range(0, len(lower) - 7, 8)):
        return True
    return any(p.fullmatch(found) for p in _ALLOWED)


def _is_word(piece: str) -> bool:
    digits, turns = _shares(piece)
    # A long piece with digits may be a word and a key without a separator.
    if digits and len(piece) >= WINDOW:
        return False
    return digits * 10 < len(piece) and (turns * 5 < len(piece) or bool(_CAMEL.fullmatch(piece)))


def remainders(found: str) -> list[tuple[int, int]]:
    """The stretches of the string beside its sequences and its neighbouring words, with the separators next to these."""
    harmless: list[tuple[int, int]] = []
    for m in _IN_SEQUENCE.finditer(found):
        if harmless and m.start() <= harmless[-1][1]:
            harmless[-1] = (harmless[-1][0], m.start() + 8)
        else:
            harmless.append((m.start(), m.start() + 8))
    words: list[tuple[int, int]] = []
    joined = False
    for m in _PIECE.finditer(found):
        if not _is_word(m[0]):
            joined = False
            continue
        a, b = max(m.start() - 1, 0), min(m.end() + 1, len(found))
        if joined:
            words[-1] = (words[-1][0], b)
        else:
            words.append((a, b))
        joined = True
    out, done = [], 0
    for a, b in sorted(harmless + [(a, b) for a, b in words if b - a >= WORDS_FROM]):
        if a > done:
            out.append((done, a))
        done = max(done, b)
    return out + [(done, len(found))] * (done < len(found))


def keys_beside_words(found: str, letters: frozenset[str], least: float) -> list[tuple[int, int]]:
    """The parts of a merged span on the allow-list that would not be on it by themselves."""
    out = []
    for begin, end in remainders(found):
        for a, b in hot_windows(found[begin:end], letters, least):
            a, b = begin + a, begin + b
            if not allowed(found[a:b].strip(_SEPARATORS)):
                out.append((a, b))
                continue
            # Without separators the windows themselves tell a key from the letters around it.
            for m in _PIECE.finditer(found, a, b):
                for c, d in _hot_keys(m[0], letters, least):
                    out.append((m.start() + c, m.start() + d))
    return out


def _hot_keys(piece: str, letters: frozenset[str], least: float) -> list[tuple[int, int]]:
    """Merged spans of the hot windows that are not on the allow-list."""
    spans: list[tuple[int, int]] = []
    for a, b in hot_windows(piece, letters, least):
        for i in range(a, b - WINDOW + 1):
            window = piece[i : i + WINDOW]
            if not allowed(window) and hot_windows(window, letters, least):
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + WINDOW)
                else:
                    spans.append((i, i + WINDOW))
    return spans


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The fixed patterns' spans and those added by entropy, as (start, end, kind)."""
    base: list[tuple[int, int, str]] = []
    added: list[tuple[int, int, str]] = []
    lower = text.lower() if text.isascii() else text.translate(_LOWER)
    if any(k in lower for k in _KEYWORDS):
        base += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    for m in _CANDIDATE.finditer(text):
        run, at = m[0], m.start()
        base += [(at + x.start(), at + x.end(), "access") for x in _ACCESS.finditer(run) if x.end() - x.start() >= 20]
        base += [(at + x.start(), at + x.end(), "hex") for x in _HEX.finditer(run) if x.end() - x.start() >= 24]
        whole: list[tuple[int, int]] = []  # spans that do not overlap, by start
        parts: list[tuple[int, int, str]] = []
        for kind, (letters, least) in CLASSES.items():
            for a, b in hot_windows(run, letters, least):
                place = bisect_left(whole, (b,))
                if place and whole[place - 1][1] > a:
                    continue
                if allowed(run[a:b]):
                    parts += [(a + c, a + d, kind) for c, d in keys_beside_words(run[a:b], letters, least)]
                else:
                    whole.insert(place, (a, b))
                    added.append((at + a, at + b, kind))
        taken = _Containers([a for a, _ in whole] + [a for a, _, _ in parts])
        for a, b in whole:
            taken.add(a, b)
        for a, b, kind in parts:
            if not taken.hold(a, b):
                taken.add(a, b)
                added.append((at + a, at + b, kind))
    base.sort(key=lambda s: (s[0], _BASE_KINDS.index(s[2])))
    fixed = _Containers([a for a, _, _ in base])
    for a, b, _ in base:
        fixed.add(a, b)
    return base, [s for s in added if not fixed.hold(s[0], s[1])]


class _Containers:
    """Spans with given starts, asked whether one of them contains another span; both in logarithmic time."""

    def __init__(self, starts: list[int]):
        self.starts = sorted(set(starts))
        self.ends = [-1] * (len(self.starts) + 1)  # a tree of greatest ends over prefixes of the starts

    def add(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start) + 1
        while i < len(self.ends):
            self.ends[i] = max(self.ends[i], end)
            i += i & -i

    def hold(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        while i:
            if self.ends[i] >= end:
                return True
            i -= i & -i
        return False


# Lower case for the ASCII letters only, so that positions and other letters stay.
_LOWER = {c: c + 32 for c in range(65, 91)}


def rendered(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64())]
        + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in word_pieces.id_and_text(batches):
            out = []
            for key, text in zip(keys, texts):
                base, added = spans_of(text or "")
                kinds = [s[2] for s in base]
                every = sorted(base + added, key=lambda s: (s[0], (*_BASE_KINDS, *CLASSES).index(s[2])))
                out.append(
                    (key, *(kinds.count(k) for k in _BASE_KINDS), hashlib.sha256(rendered(base).encode()).hexdigest(), rendered(every), len(every))
                )
            yield word_pieces.arrow_batch(schema, list(zip(*out)) or [[]] * 7)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by ``[SECRET]``; all rows and all columns stay, ``n_chars`` follows the text."""
    fields = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else without(t) for t in batch.column(at).to_pylist()]
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, fields)
    if "n_chars" not in docs.columns:
        return out
    length = F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNull(), F.col("n_chars")).otherwise(length))


def without(text: str) -> str:
    """The text with its secrets replaced; overlapping spans are replaced together."""
    base, added = spans_of(text)
    out: list[str] = []
    done = 0
    end = 0
    for a, b, _ in sorted(base + added):
        if a < end:
            end = max(end, b)
            continue
        if end:
            out.append("[SECRET]")
            done = end
        out.append(text[done:a])
        done, end = a, b
    return "".join(out) + ("[SECRET]" if end else "") + text[end or done :]
