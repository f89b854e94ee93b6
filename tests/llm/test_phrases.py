"""Collocations against brute force."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from skylane.llm import phrase_trees
from tests.llm.samples import collected, edge_rows, empty, table

COLUMNS = "doc_id long, lang string, text string"


def brute(rows, least=30, top=2000, share=80):
    counts = defaultdict(Counter)
    for _, lang, text in rows:
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        chosen = {k: v for k, v in f.items() if 2 <= len(k) and v >= least}
        best = []
        for phrase, a in chosen.items():
            score, k = min((2_000_000 * a // (f[phrase[:k]] + f[phrase[k:]]), k) for k in range(1, len(phrase)))
            longer = [v for o, v in chosen.items() if len(o) > len(phrase) and any(o[i : i + len(phrase)] == phrase for i in range(len(o)))]
            if not any(100 * v >= share * a for v in longer):
                best.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out, key=repr)


def drawn_rows(seed, count=400):
    r = random.Random(seed)
    common = "of the an a in to new york city hall über alles é".split()
    fixed = ["new york city hall", "once upon a time", "in the end", "the the the the the", "Über alles", "of the of the"]
    rows = []
    for i in range(count):
        words = []
        for _ in range(r.randint(0, 30)):
            words.append(r.choice(fixed) if r.random() < 0.3 else r.choice(common) if r.random() < 0.8 else f"w{r.randint(0, 400)}")
            words.append(r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ! "]))
        rows.append((i, r.choice(["en", "de", None, "und"]), "".join(words)))
    return rows


@pytest.mark.parametrize("least, top", [(30, 2000), (3, 40), (1, 5_000)])
def test_phrases_of_drawn_texts(spark, least, top):
    rows = drawn_rows(least)
    found = collected(phrase_trees.collocations(table(spark, rows, COLUMNS), least, top))
    assert found == brute(rows, least, top) and len(found) > 20


@pytest.mark.parametrize("budget", [8, 80, 800])
def test_extended_prefixes_and_small_portions_change_nothing(spark, monkeypatch, budget):
    # Under the smallest budget nearly all prefixes are heavy, so suffixes of one word meet in different groups.
    monkeypatch.setattr(phrase_trees, "BUDGET", budget)
    monkeypatch.setattr(phrase_trees, "PORTION", 700)
    monkeypatch.setattr(phrase_trees, "RANK_SPLITS", 3)
    rows = drawn_rows(11, 250)
    assert collected(phrase_trees.collocations(table(spark, rows, COLUMNS), 5, 60)) == brute(rows, 5, 60)


def test_full_bit_tables_change_nothing(spark, monkeypatch):
    for name in ("WORD_BITS", "PAIR_BITS", "HEAVY_BITS"):
        monkeypatch.setattr(phrase_trees, name, 6)
    rows = drawn_rows(12, 250)
    assert collected(phrase_trees.collocations(table(spark, rows, COLUMNS), 5, 60)) == brute(rows, 5, 60)


def test_suffixes_are_spelled_in_bounded_memory():
    r = random.Random(5)
    words = 200_000
    text = " ".join(f"w{r.randint(0, 5_000)}" for _ in range(words))
    every = np.full(1, -1, dtype=np.int64).view(np.uint64)
    run = phrase_trees.suffixes(SimpleNamespace(mapInArrow=lambda run, schema: run), every, every, every * 0, 8)
    before, most, found = pa.total_allocated_bytes(), 0, 0
    tracemalloc.start()
    for batch in run(iter([pa.record_batch([pa.array(["en"]), pa.array([text])], names=["lang", "text"])])):
        found += sum(batch.column(4).to_pylist())
        most = max(most, pa.total_allocated_bytes() - before)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == words - 1
    # Spelled suffixes held at once, and the numbers beside them: 14.8 MB and 280 bytes a word when a portion was spelled whole.
    assert most < 6_000_000
    assert peak < 240 * words


def test_edge_texts(spark):
    rows = [(i, None, t) for i, t in edge_rows()] + [(50, "en", None), (51, "en", "  "), (52, "xx", "alone"), (53, "x", "b " * 100), (54, "x", "a\x0bb c\x85d e f\x1cg " * 40)]
    found = collected(phrase_trees.collocations(table(spark, rows, COLUMNS)))
    assert found == brute(rows)
    assert {r[0] for r in found} == {"und", "x"}


def test_scores_need_more_than_64_bits(spark):
    parts = [("x", "a b", 2**60, ), ("x", "c d", 2**59)]
    phrases = spark.createDataFrame(parts, "lang string, phrase string, f long")
    words = spark.createDataFrame([("x", "a", 2**61), ("x", "b", 2**61 + 1), ("x", "c", 2**59), ("x", "d", 2**59)], "lang string, word string, f long")
    found = [(r.phrase, r.score) for r in phrase_trees.ranked(phrases, words, 30, 10, 80).orderBy("rank").collect()]
    assert found == [("c d", 1_000_000), ("a b", 2_000_000 * 2**60 // (2**62 + 1))]


def test_no_rows(spark):
    assert phrase_trees.collocations(empty(spark, COLUMNS)).collect() == []
