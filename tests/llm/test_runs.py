"""Periodic runs against brute force."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from skylane.llm import periodic_runs
from tests.llm.samples import collected, edge_rows, empty, prose, table


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def brute_runs(words):
    out = set()
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and smallest_period(words[i : j + q]) == q:
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None and n and crc32(str(doc_id).encode()) % 10 == 0:
        g = crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    shown = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    rest = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())


def drawn_texts(seed, count):
    r = random.Random(seed)
    for _ in range(count):
        letters = "ab" if r.random() < 0.5 else "abcdefgh"
        words = []
        for _ in range(r.randint(0, 6)):
            unit = [r.choice(letters) for _ in range(r.randint(1, 7))]
            words += unit * r.randint(1, 7) + unit[: r.randint(0, len(unit))] + [r.choice(letters) for _ in range(r.randint(0, 5))]
        yield words


def numbered(words):
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_drawn_words(seed):
    texts = [*drawn_texts(seed, 250), ["a"] * 300, ["a", "b"] * 200, [], ["x"], (["a"] * 5 + ["b"]) * 30]
    found = periodic_runs.runs([numbered(w) for w in texts])
    for words, rows in zip(texts, found):
        assert [tuple(r) for r in rows.tolist()] == brute_runs(words), words


def test_small_portions_of_the_grid_change_nothing(monkeypatch):
    texts = [numbered(w) for w in drawn_texts(77, 120)]
    whole = periodic_runs.runs(texts)
    monkeypatch.setattr(periodic_runs, "GRID_PORTION", 50)
    assert all((a == b).all() for a, b in zip(whole, periodic_runs.runs(texts)))


@pytest.mark.parametrize("mirrored", [False, True])
def test_extensions_are_exact(mirrored):
    r = random.Random(5)
    words = [r.randint(0, 1) for _ in range(400)] + [0] * 60 + [0, 1, 1] * 40
    symbols = np.array([-1, *words, -2])
    rounds = periodic_runs.grammar(symbols)
    pairs = [sorted(r.sample(range(1, len(words) + 1), 2)) for _ in range(3_000)]
    x, y = (np.array(c) for c in zip(*pairs))
    step = -1 if mirrored else 1

    def agree(i, j):
        k = 0
        while symbols[i + step * k] == symbols[j + step * k]:
            k += 1
        return k

    assert periodic_runs.extension(rounds, x, y, mirrored).tolist() == [agree(i, j) for i, j in pairs]


def test_rounds_shrink_and_spell_the_text():
    words = np.array([-1, *np.random.default_rng(3).integers(0, 50, 20_000), -2])
    rounds = periodic_runs.grammar(words)
    assert sum(len(r.symbols) for r in rounds) < 12 * len(words)
    assert len(rounds[-1].symbols) == 3
    for low, high in zip(rounds, rounds[1:]):
        spelled = {}
        for at, name in enumerate(high.symbols.tolist()):
            part = tuple(low.symbols[low.first[at] : low.first[at + 1]].tolist())
            assert spelled.setdefault(name, part) == part


def test_rows_of_edge_texts(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PORTION", 500)
    r = random.Random(9)
    rows = [x for x in edge_rows() if len(x[1] or "") < 3_000] + [(i, prose(i, r.randint(1, 90))) for i in range(100, 260)]
    rows += [(400 + i, " ".join(w)) for i, w in enumerate(drawn_texts(12, 60))]
    expected = sorted((brute_row(*x) for x in rows), key=repr)
    assert collected(periodic_runs.find(table(spark, rows))) == expected
    assert sum(x[1] for x in expected) > 20


def test_very_long_texts_and_no_rows(spark):
    assert periodic_runs.find(empty(spark)).collect() == []
    long = "word " * 200_000
    rows = [(None, long), (7, "a" * 300_000), (None, prose(4, 60_000) + " " + "x y z " * 5_000)]
    found = sorted(periodic_runs.find(table(spark, rows)).collect(), key=lambda r: (r.n_runs, r.length or 0))
    assert [(r.n_runs, r.start, r.length, r.period) for r in found] == [(0, None, None, None), (1, 60_000, 15_000, 3), (1, 0, 200_000, 1)]
