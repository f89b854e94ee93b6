"""Stretches of words that repeat with a period, found by recompression of the texts.

A run is a stretch of consecutive words with smallest period q, at least ``max(LEAST_WORDS, LEAST_POWERS * q)``
words long, that neither neighbour extends. For every text:

1. ``candidates``: a harmonic grid. For every period p the words at 0, p, 2p, ... are compared with their next in
   the grid. A run of period p covers at least three such neighbouring comparisons, so only every third grid point
   is looked at, and only those in three agreeing comparisons go on: n log n points at most, exact.
2. ``grammar``: the texts that have a candidate are recompressed, together and with a barrier between any two.
   Rounds alternate between blocks (equal neighbours become one symbol with their number) and pairs (symbols are
   dealt to a left and a right half; each left one followed by a right one becomes one symbol), until each text is
   one symbol. Equal words spell equal symbols away from the edges of a stretch, since either rule looks at
   neighbours only. Each round keeps, besides the symbols, where a symbol's first part stands and whose part it is.
3. ``extension``: how far two positions agree. Both climb while their symbols agree, taking at most one part
   per round, and go down again from the round in which they first differ; two numbers of steps per round. Looking
   the other way, the same rounds are read mirrored. A candidate extended both ways gives the exact run.

Every text is one row of one task; nothing is shuffled. Texts are taken in portions of about ``PORTION`` words, a
longer one by itself; a grammar takes about 100 bytes for each word of the texts that have a candidate.

Defined results: a null text has no words; a row without an id has its words taken as they are; no run gives nulls
for the longest one and the digest of nothing for the runs; rows that repeat an id are answered one by one; an
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylane.llm import word_pieces

LEAST_WORDS = 6
LEAST_POWERS = 4
# Words that are worked on together, and grid points.
PORTION = 150_000
GRID_PORTION = 1_000_000

_FIELDS = [(n, pa.int64()) for n in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
_SCHEMA = pa.schema([*_FIELDS, ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


@dataclass
class Round:
    """The symbols of one round (barriers are negative) and, but for the last, how they make up the next one's."""

    symbols: np.ndarray
    blocks: bool = False  # whether the next round's symbols are blocks of equal ones
    owner: np.ndarray | None = None  # per symbol the place of the next round's symbol that it is part of
    first: np.ndarray | None = None  # per symbol of the next round the place of its first part, and the end


def _named(keys: np.ndarray, barriers: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Dense names of equal keys; barriers keep theirs."""
    out = held.copy()
    out[~barriers] = np.unique(keys[~barriers], return_inverse=True)[1]
    return out


def grammar(symbols: np.ndarray) -> list[Round]:
    """The rounds of a sequence in which every text stands between negative, all different barriers."""
    rounds = [Round(symbols.astype(np.int64))]
    deal = np.random.default_rng(len(symbols))
    while True:
        s = rounds[-1].symbols
        plain = s >= 0
        if not (plain[1:] & plain[:-1]).any():
            return rounds
        starts = np.concatenate(([True], s[1:] != s[:-1]))
        if not starts.all():
            first = np.flatnonzero(starts)
            sizes = np.diff(np.append(first, len(s)))
            held = s[first]
            made = _named(held * (sizes.max() + 1) + sizes, held < 0, held)
            _close(rounds, True, starts, first, made)
            s, plain = made, made >= 0
        several = int(s.max()) + 1
        left = deal.integers(0, 2, several).astype(bool)
        on_left = plain & left[np.maximum(s, 0)]
        on_right = plain & ~on_left
        joined = on_left[:-1] & on_right[1:]
        other = on_right[:-1] & on_left[1:]
        if other.sum() > joined.sum():
            joined = other
        if joined.any():
            starts = np.concatenate(([True], ~joined))
            first = np.flatnonzero(starts)
            held = s[first]
            paired = np.append(joined, False)[first]
            keys = held.copy()
            keys[paired] += several * (s[first[paired] + 1] + 1)
            _close(rounds, False, starts, first, _named(keys, held < 0, held))


def _close(rounds: list[Round], blocks: bool, starts: np.ndarray, first: np.ndarray, made: np.ndarray) -> None:
    done = rounds[-1]
    done.blocks = blocks
    done.owner = (np.cumsum(starts) - 1).astype(np.int32)
    done.first = np.append(first, len(done.symbols)).astype(np.int32)
    rounds.append(Round(made))


class _Reader:
    """A round read from left to right, or mirrored."""

    def __init__(self, held: Round, mirrored: bool):
        self.held, self.mirrored, self.end = held, mirrored, len(held.symbols)
        self.owners = 0 if held.first is None else len(held.first) - 1

    def symbol(self, at: np.ndarray) -> np.ndarray:
        return self.held.symbols[self.end - 1 - at if self.mirrored else at]

    def owner(self, at: np.ndarray) -> np.ndarray:
        return self.owners - 1 - self.held.owner[self.end - 1 - at] if self.mirrored else self.held.owner[at]

    def first(self, owner: np.ndarray) -> np.ndarray:
        return self.end - self.held.first[self.owners - owner] if self.mirrored else self.held.first[owner]

    def steps(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many equal symbols follow from x, and from y, within what the next round takes together."""
        if not self.held.blocks:
            return np.ones_like(x), np.ones_like(y)
        return self.first(self.owner(x) + 1) - x, self.first(self.owner(y) + 1) - y


def extension(rounds: list[Round], x: np.ndarray, y: np.ndarray, mirrored: bool = False) -> np.ndarray:
    """How many symbols from x[i] on equal those from y[i] on (mirrored: up to x[i] and y[i], looking back)."""
    readers = [_Reader(r, mirrored) for r in rounds]
    if mirrored:
        x, y = readers[0].end - 1 - x, readers[0].end - 1 - y
    a, b = x.copy(), y.copy()
    differ = np.full(len(x), len(rounds) - 1)
    live = np.arange(len(x))
    for level, r in enumerate(readers[:-1]):
        p, q = a[live], b[live]
        inside = (r.first(r.owner(p)) != p) | (r.first(r.owner(q)) != q)
        same = r.symbol(p) == r.symbol(q)
        of_p, of_q = r.steps(p, q)
        step = np.where(inside & same, np.minimum(of_p, of_q), 0)
        p, q = p + step, q + step
        ends = inside & (~same | (of_p != of_q))
        a[live], b[live] = p, q
        differ[live[ends]] = level
        live, p, q = live[~ends], p[~ends], q[~ends]
        a[live], b[live] = r.owner(p), r.owner(q)
    for level in range(len(readers) - 1, -1, -1):
        r = readers[level]
        here = np.flatnonzero(differ >= level)
        p, q = a[here], b[here]
        while (same := r.symbol(p) == r.symbol(q)).any():
            of_p, of_q = r.steps(p, q)
            step = np.where(same, np.minimum(of_p, of_q), 0)
            p, q = p + step, q + step
        if level:
            p, q = readers[level - 1].first(p), readers[level - 1].first(q)
        a[here], b[here] = p, q
    return a - x


def candidates(symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, place in it and period of grid points that lie in three agreeing comparisons of a grid."""
    widest = np.where(sizes >= LEAST_WORDS, sizes // LEAST_POWERS, 0)
    text = np.repeat(np.arange(len(sizes)), widest)
    period = np.arange(len(text)) - np.repeat(np.cumsum(widest) - widest, widest) + 1
    points = ((sizes[text] - 1) // period + 2) // 3
    ends = np.cumsum(points)
    found = []
    low = 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + GRID_PORTION)))
        t, p = np.repeat(text[low:high], points[low:high]), np.repeat(period[low:high], points[low:high])
        k = 3 * (np.arange(len(t)) - np.repeat(ends[low:high] - points[low:high] - (ends[low - 1] if low else 0), points[low:high]))

        def agree(shift: int, t=None, p=None, k=None) -> np.ndarray:
            at, end = (k + shift) * p, sizes[t]
            valid = (k + shift >= 0) & (at + p < end)
            place = begins[t] + np.where(valid, at, 0)
            return valid & (symbols[place] == symbols[np.where(valid, place + p, place)])

        kept = agree(0, t, p, k)
        t, p, k = t[kept], p[kept], k[kept]
        before, after = agree(-1, t, p, k), agree(1, t, p, k)
        kept = (before & after) | (before & agree(-2, t, p, k)) | (after & agree(2, t, p, k))
        found.append((t[kept], (k * p)[kept], p[kept]))
        low = high
    empty = np.empty(0, dtype=np.int64)
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (empty, empty, empty)


def runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Per text (an array of word numbers) its runs as rows (start, length, period), by start, then period."""
    none = np.empty((0, 3), dtype=np.int64)
    out = [none] * len(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return out
    text, at, period = candidates(np.concatenate(texts), np.cumsum(sizes) - sizes, sizes)
    chosen, text = np.unique(text, return_inverse=True)
    if not len(chosen):
        return out
    parts, begins, end = [np.array([-1])], [], 1
    for number, t in enumerate(chosen):
        begins.append(end)
        parts += [texts[t], np.array([-2 - number])]
        end += len(texts[t]) + 1
    begins = np.array(begins)
    rounds = grammar(np.concatenate(parts))
    x = begins[text] + at
    back = extension(rounds, x - 1, x + period - 1, mirrored=True)
    length = back + period + extension(rounds, x, x + period)
    start = at - back
    kept = length >= np.maximum(LEAST_WORDS, LEAST_POWERS * period)
    rows = np.unique(np.stack((text, start, length, period), axis=1)[kept], axis=0)
    # Of equal stretches the first row has the smallest period; the others are its multiples.
    if len(rows):
        rows = rows[np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))]
        rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
        edges = np.searchsorted(rows[:, 0], np.arange(len(chosen) + 1))
        for number, t in enumerate(chosen):
            out[t] = rows[edges[number] : edges[number + 1], 1:]
    return out


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, with a repeating tail in a tenth of the ids, as the query's contract has it."""
    drawn, n = crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if drawn % 10 or not n:
        return words
    g = drawn // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(found):
        return words
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(steps, found[:, 0] + found[:, 2], 1)
    np.add.at(steps, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(steps[:-1]) == 0
    return [w for w, stays in zip(words, kept) if stays]


def _facts(doc_id: int | None, words: list[bytes], found: np.ndarray) -> tuple:
    best = (None, None, None, None)
    if len(found):
        start, length, period = (int(v) for v in found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]])
        best = (start, length, period, 1000 * length // period)
    shown = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
    digests = (hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest())
    return (doc_id, len(found), *best, *digests)


def _portion(rows: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    texts = [np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)) for _, words in rows]
    facts = [_facts(key, words, found) for (key, words), found in zip(rows, runs(texts))]
    columns = list(zip(*facts)) if facts else [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def find(docs: DataFrame, tails: bool = True) -> DataFrame:
    """Per document its number of runs, the longest one, and digests of all runs and of the collapsed text.

    ``tails`` plants the contract's repeating tails first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for ids, texts in word_pieces.id_and_text(batches):
            for key, text in zip(ids, texts):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                rows.append((key, planted(key, words) if tails else words))
                held += len(words) + 1
                if held >= PORTION:
                    yield _portion(rows)
                    rows, held = [], 0
        yield _portion(rows)

    shown = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{n} long" for n, _ in _FIELDS)
    return shown.mapInArrow(run, f"{kinds}, runs_sha256 string, collapsed_sha256 string")
