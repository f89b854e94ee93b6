"""The Hamming join against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylane.llm import hamming_join
from skylane.llm.adaptive_join import Similarity
from skylane.llm.hamming_join import Signatures
from tests.llm.samples import collected, edge_rows, empty, prose, table
from tests.llm.test_dedup import brute_classes, changed

FIVE = Signatures(Similarity(5, 85))


def brute(rows):
    return sorted(((i, n, c, i == c) for i, n, c in brute_classes(rows, FIVE.similarity)), key=repr)


@pytest.mark.parametrize("signatures", [FIVE, Signatures(Similarity(3, 90), 64, 4), Signatures(Similarity(5, 60), 100, 3)], ids=str)
def test_every_pair_within_the_radius_has_a_key_in_common(spark, signatures):
    chunks = signatures.chunks()
    assert sum(size for _, size, _ in chunks) == signatures.symbols
    assert sum(errors + 1 for _, _, errors in chunks) == signatures.radius + 1
    r = np.random.default_rng(1)
    rows = []
    for i in range(300):
        a = r.integers(0, 2**16, signatures.symbols, dtype=np.uint16)
        b = a.copy()
        # Errors drawn evenly, and errors laid so that as many chunks as possible are hit.
        spread = [begin + k for k in range(signatures.chunk) for begin, size, _ in chunks if k < size]
        places = r.permutation(signatures.symbols)[: signatures.radius] if i % 2 else spread[: signatures.radius]
        b[places] ^= r.integers(1, 2**16, len(places), dtype=np.uint16)
        rows.append((a.tobytes(), b.tobytes()))
    df = spark.createDataFrame(rows, "a binary, b binary")
    found = df.select(F.arrays_overlap(signatures.keys(F.col("a")), signatures.keys(F.col("b"))).alias("met"))
    assert found.filter("NOT met").count() == 0


def test_signatures_differ_as_their_sets_do():
    r = np.random.default_rng(2)
    sizes, distances = [], []
    for _ in range(300):
        common = r.integers(0, 2**63, 170, dtype=np.uint64)
        a, b = (np.concatenate((common, r.integers(0, 2**63, 15, dtype=np.uint64))) for _ in range(2))
        one, two = (np.frombuffer(FIVE.of(np.unique(s)), dtype="<u2") for s in (a, b))
        sizes.append(170 / 200)
        distances.append(int((one != two).sum()))
    assert abs(np.mean(distances) - 128 * 0.15) < 1
    assert np.std(distances) < 5 and max(distances) <= FIVE.radius


def test_edge_rows(spark):
    rows = edge_rows()
    assert collected(hamming_join.near_copies(table(spark, rows), FIVE)) == brute(rows)


@pytest.mark.parametrize("block, long_list", [(256, 64), (6, 4)])
def test_families_chains_and_passages(spark, monkeypatch, block, long_list):
    # With small bounds, lists and families are cut into cells.
    monkeypatch.setattr(hamming_join, "BLOCK", block)
    monkeypatch.setattr(hamming_join, "LONG_LIST", long_list)
    monkeypatch.setattr(hamming_join, "BLOCK_ELEMENTS", 1_000_000 if block > 100 else 4_000)
    passage = prose(99, 60)
    texts = []
    for family in range(6):
        base = prose(family, 150)
        texts += [changed(base, 100 * family + j, share) for j in range(10) for share in (0.004, 0.012, 0.02, 0.03)]
        chain = prose(700 + family, 200).split()
        texts += [" ".join(chain[12 * j : 12 * j + 160]) for j in range(4)]
    texts += [prose(1000 + j, 60) + " " + passage + " " + prose(2000 + j, 60) for j in range(40)]
    texts += texts[:30]
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    expected = brute(rows)
    assert collected(hamming_join.near_copies(table(spark, rows), FIVE)) == expected
    assert 20 < sum(r[3] for r in expected) < len(rows) - 100


def test_full_bit_table_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(hamming_join, "FAMILY_BITS", 6)
    base = prose(5, 200)
    rows = [(j, changed(base, j, 0.005)) for j in range(40)] + [(50 + j, prose(60 + j, 80)) for j in range(100)]
    assert collected(hamming_join.near_copies(table(spark, rows), FIVE)) == brute(rows)


def test_nothing_to_link(spark):
    assert hamming_join.near_copies(empty(spark), FIVE).collect() == []
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (None, "a b c d e f"), (3, None)]
    assert collected(hamming_join.near_copies(table(spark, rows), FIVE)) == brute(rows)
