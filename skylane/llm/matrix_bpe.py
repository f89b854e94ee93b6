"""Byte-level BPE in numpy: many words at once as padded matrices, merged in rounds.

A worker cuts texts into words by the vocabulary's pattern and collects the distinct words that it has
not met yet. Those are grouped by length into padded matrices of token ids. In every round each row
looks up the ranks of its neighbouring pairs in a hash table (two arrays, open addressing), merges its
leftmost pair of least rank and closes the gap; rows without a pair leave the matrix. Words longer than
``LONGEST_ROW`` bytes, which would need as many rounds, are merged by a heap over a linked list instead.
A word that is itself in the vocabulary is its own token, as in the library whose ids these are.

Defined results: a null text counts as empty and has no ids; rows with null or repeated ids are answered
one by one; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylane.llm import word_pieces

LONGEST_ROW = 128
# Words remembered by one worker; beyond it the memory is emptied and filled anew, which costs time only.
REMEMBERED = 600_000
# Characters of the longest chunk that is remembered, so what a worker remembers is bounded in bytes too.
LONGEST_REMEMBERED = 64
# Characters of text whose unknown words are merged together.
_TOGETHER = 4_000_000
_CUT = re.compile(r"(?<!\s) ")
_NONE = np.iinfo(np.int64).max
_loaded: dict[tuple[str, str], MatrixBpe] = {}


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their joined bytes."""

    def __init__(self, pairs: dict[int, int]):
        bits = max(4, (3 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, _NONE, dtype=np.int64)
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        values = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        at = self._slot(keys)
        self.steps = 0
        while len(keys):
            free = self.keys[at] == -1
            # Of several keys that want one slot the first gets it.
            _, first = np.unique(at, return_index=True)
            wins = np.zeros(len(at), dtype=bool)
            wins[first] = True
            wins &= free
            self.keys[at[wins]] = keys[wins]
            self.values[at[wins]] = values[wins]
            keys, values, at = keys[~wins], values[~wins], (at[~wins] + 1) & self.mask
            self.steps += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The joined id of each pair key, or the largest integer."""
        at = self._slot(keys)
        seen = self.keys[at]
        found = np.where(seen == keys, self.values[at], _NONE)
        left = np.flatnonzero((seen != keys) & (seen != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            seen = self.keys[at[left]]
            hit = seen == keys[left]
            found[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (seen != -1)]
        return found


class MatrixBpe:
    def __init__(self, path: str, pattern: str):
        import regex

        self.words = regex.compile(pattern).findall
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.width = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * self.width
        for t, n in self.ranks.items():
            self.bytes_of[n] = t
        self.decimal = list(map(str, range(self.width)))
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs = {
            self.ranks[t[:i]] * self.width + self.ranks[t[i:]]: n
            for t, n in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        }
        self.table = PairTable(self.pairs)
        self.known: dict[str, bytes] = {}

    def merge_rows(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of at most ``LONGEST_ROW`` bytes."""
        lengths = np.array([len(w) for w in words])
        done: list[list[int]] = [[] for _ in words]
        edges = [1, 4, 8, 12, 16, 24, 32, 64, LONGEST_ROW]
        for low, high in zip([0, *edges], edges):
            chosen = np.flatnonzero((lengths > low) & (lengths <= high))
            if not len(chosen):
                continue
            raw = np.frombuffer(b"".join(words[i].ljust(high, b"\0") for i in chosen), dtype=np.uint8)
            rows = self.single[raw.reshape(len(chosen), high)]
            size = lengths[chosen].copy()
            columns = np.arange(high)
            while len(chosen):
                if rows.shape[1] > 1:
                    keys = rows[:, :-1] * self.width + rows[:, 1:]
                    ranks = self.table.find(keys.ravel()).reshape(keys.shape)
                    ranks[columns[None, 1 : rows.shape[1]] >= size[:, None]] = _NONE
                    best = ranks.argmin(axis=1)
                    rank = ranks[np.arange(len(rows)), best]
                else:
                    best, rank = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), _NONE)
                over = rank == _NONE
                for i in np.flatnonzero(over).tolist():
                    done[chosen[i]] = rows[i, : size[i]].tolist()
                # Rows that are through leave; in the others the merged token takes the pair's place.
                rows, size, chosen, best, rank = rows[~over], size[~over] - 1, chosen[~over], best[~over], rank[~over]
                if not len(chosen):
                    break
                rows[np.arange(len(rows)), best] = rank
                places = columns[None, : rows.shape[1] - 1]
                rows = np.where(places > best[:, None], rows[:, 1:], rows[:, :-1])
        return done

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges for one long word: a heap of (rank, place) over a linked list."""
        ids = self.single[np.frombuffer(word, dtype=np.uint8)].tolist()
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        heap = [(r, i) for i in range(len(ids) - 1) if (r := self.pairs.get(ids[i] * self.width + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or self.pairs.get(ids[i] * self.width + ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (r := self.pairs.get(ids[a] * self.width + ids[after[a]])) is not None:
                    heapq.heappush(heap, (r, a))
        return [n for n in ids if n >= 0]

    def learn(self, words: set[str]) -> None:
        """Put the ids of unknown words into the memory, as little-endian 32-bit bytes."""
        short: list[str] = []
        for w in words:
            b = w.encode()
            if b in self.ranks:
                self.known[w] = packed([self.ranks[b]])
            elif len(b) <= LONGEST_ROW:
                short.append(w)
            else:
                self.known[w] = packed(self.merge_long(b))
        self.known.update(zip(short, map(packed, self.merge_rows([w.encode() for w in short]))))

    def chunks(self, text: str) -> list[str]:
        """Parts that the pattern would never match across; each is cut by the pattern when it is new.

        A single blank between characters that are not white space always starts a new match, so texts are
        cut before such blanks. After other white space this would not hold, such parts stay together. With
        two blanks in a row the text stays whole.
        """
        if "  " in text:
            return [text]
        head, *rest = _CUT.split(text)
        return ([head] if head else []) + [" " + c for c in rest]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        parts = [self.chunks(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        unknown = set().union(*parts) - self.known.keys()
        cut = {c: self.words(c) for c in unknown}
        self.learn({w for ws in cut.values() for w in ws if w not in self.known})
        known = self.known.__getitem__
        for c, ws in cut.items():
            if len(ws) > 1:
                self.known[c] = b"".join(map(known, ws))
        out = [np.frombuffer(b"".join(map(known, p)), dtype="<u4").tolist() for p in parts]
        # Long chunks and words hardly come again, and a text without single blanks is one chunk: they are forgotten.
        for w in {w for c, ws in cut.items() for w in (c, *ws) if len(w) > LONGEST_REMEMBERED}:
            self.known.pop(w, None)
        return out

    def rendered(self, ids: list[int]) -> str:
        return ",".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def load(path: str, pattern: str) -> MatrixBpe:
    """One instance per worker process and vocabulary."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = MatrixBpe(path, pattern)
    return _loaded[path, pattern]


def portions(texts: list[str]) -> Iterator[slice]:
    """Slices of about ``_TOGETHER`` characters, one text at least."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= _TOGETHER:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 of the encoded ids, decoded_sha256 of the bytes decoded from them."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for keys, texts in word_pieces.id_and_text(batches):
            texts = [t or "" for t in texts]
            for span in portions(texts):
                out = []
                for key, ids in zip(keys[span], bpe.encode(texts[span])):
                    shown = hashlib.sha256(bpe.rendered(ids).encode()).hexdigest()
                    out.append((key, len(ids), shown, hashlib.sha256(bpe.decode(ids)).hexdigest()))
                yield word_pieces.arrow_batch(schema, list(zip(*out)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
