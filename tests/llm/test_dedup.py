"""Exact digests and similarity classes against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from skylane.llm import adaptive_join, digest_index
from skylane.llm.adaptive_join import Similarity
from tests.llm.samples import collected, edge_rows, empty, prose, table


def brute_digests(rows):
    shown = [(i, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest(), len(t or "")) for i, t in rows]
    out = []
    for i, d, _ in shown:
        group = [x for x in shown if x[1] == d]
        keep = min(group, key=lambda x: (-x[2], x[0] is None, x[0] or 0))[0]
        out.append((i, keep, len(group), i == keep, d))
    return sorted(out, key=repr)


def test_exact_duplicates_of_edge_rows(spark):
    rows = edge_rows()
    found = digest_index.fresh_index(spark).deduplicate(table(spark, rows))
    assert collected(found) == brute_digests(rows)


def test_hot_group_and_empty_batch(spark):
    rows = [(i, "same  text" if i % 3 == 0 else f"text {i}") for i in range(6_000)]
    index = digest_index.fresh_index(spark)
    assert collected(index.deduplicate(table(spark, rows))) == brute_digests(rows)
    assert index.deduplicate(empty(spark)).collect() == []


def test_index_persists_over_batches(spark):
    index = digest_index.fresh_index(spark)
    index.deduplicate(table(spark, [(5, "a b"), (6, "c")])).collect()
    second = {r.doc_id: r for r in index.deduplicate(table(spark, [(1, "a  b"), (2, "d")])).collect()}
    assert (second[1].keep_id, second[1].kept, second[1].group_size) == (5, False, 1)
    assert second[2].kept
    assert index.table().count() == 3
    buckets = spark.sql(f"DESCRIBE EXTENDED {index.name}").filter("col_name = 'Num Buckets'").first()
    assert buckets.data_type == str(digest_index.BUCKETS)


def test_stage_keeps_one_row_of_each_text(spark):
    rows = [(1, "a b"), (2, "a  b"), (2, "other"), (3, None), (4, ""), (5, "c")]
    docs = table(spark, rows)
    kept = digest_index.without_copies(docs, digest_index.fresh_index(spark))
    assert kept.columns == docs.columns
    assert collected(kept.select("doc_id", "text")) == sorted([(2, "a  b"), (2, "other"), (3, None), (5, "c")], key=repr)


def test_stage_keeps_one_of_rows_that_repeat_an_id_or_have_none(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "ab"), (None, "no id"), (None, "no id"), (None, "noid"), (7, "y y"), (None, "y  y"), (8, None), (8, None)]
    docs = table(spark, rows)
    kept = collected(digest_index.without_copies(docs, digest_index.fresh_index(spark)).select("doc_id", "text"))
    assert kept == sorted([(1, "a b"), (None, "no id"), (None, "y  y"), (8, None)], key=repr) or kept == sorted(
        [(1, "ab"), (None, "no id"), (None, "y  y"), (8, None)], key=repr
    )


def shingles(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_classes(rows, similarity):
    sets = [shingles(t, similarity.words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                common = len(sets[a] & sets[b])
                if 100 * common >= similarity.percent * len(sets[a] | sets[b]):
                    parent[root(a)] = root(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    best = {r: min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for r, g in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), best[root(i)]) for i in range(len(rows))), key=repr)


def changed(text, seed, share):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else f"new{r.randint(0, 10**9)}" for w in text.split())


@pytest.mark.parametrize("similarity", [Similarity(3, 90), Similarity(5, 80)], ids=str)
def test_similarity_classes_of_edge_rows(spark, similarity):
    rows = edge_rows()
    assert collected(adaptive_join.similarity_classes(table(spark, rows), similarity)) == brute_classes(rows, similarity)


@pytest.mark.parametrize("similarity", [Similarity(3, 90), Similarity(5, 80)], ids=str)
def test_families_passages_and_lists_longer_than_a_block(spark, similarity, monkeypatch):
    # Small bounds, so that long lists and several cells occur.
    monkeypatch.setattr(adaptive_join, "LONG_LIST", 5)
    monkeypatch.setattr(adaptive_join, "BLOCK", 8)
    monkeypatch.setattr(adaptive_join, "BLOCK_ELEMENTS", 3_000)
    passage = prose(99, 60)
    texts = []
    for family in range(6):
        base = prose(family, 150)
        texts += [changed(base, 100 * family + j, share) for j in range(12) for share in (0.004, 0.012, 0.03)]
    texts += [prose(1000 + j, 60) + " " + passage + " " + prose(2000 + j, 60) for j in range(40)]
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    assert collected(adaptive_join.similarity_classes(table(spark, rows), similarity)) == brute_classes(rows, similarity)


@pytest.mark.parametrize("similarity, tails", [(Similarity(3, 90), (6, 10)), (Similarity(5, 80), (13, 24))], ids=str)
def test_long_lists_of_one_base_with_own_tails(spark, similarity, tails):
    # Each text is linked with the bare base, which is smaller, and with no other text.
    rows = []
    for group in range(3):
        base = prose(300 + group, 100 + similarity.words - 1)
        texts = [base] + [f"{base} {prose(10_000 * (group + 1) + j, tails[0] + j % (tails[1] - tails[0] + 1))}" for j in range(adaptive_join.LONG_LIST + 20)]
        rows += [(1_000 * group + j, t) for j, t in enumerate(texts)]
    expected = brute_classes(rows, similarity)
    assert {c for _, _, c in expected} == {0, 1_000, 2_000}
    assert collected(adaptive_join.similarity_classes(table(spark, rows), similarity)) == expected


def test_lists_and_sets_of_few_families_are_shuffled_once(spark, monkeypatch):
    plans, write = {}, adaptive_join.written

    def planned(df, label, *more):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label, *more)

    monkeypatch.setattr(adaptive_join, "written", planned)
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    rows = [(10 * family + j, changed(prose(family, 150), 10 * family + j, 0.004)) for family in range(3) for j in range(4)]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = collected(adaptive_join.similarity_classes(table(spark, rows), Similarity(3, 90)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == brute_classes(rows, Similarity(3, 90))
    # The sets go to their family, and to nothing before; the lists meet themselves.
    assert plans["family-links"].count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plans["family-links"]
    assert "ReusedExchange" in plans["met"]


def test_families_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr("skylane.session.BROADCAST_ROWS", 0)
    rows = [(10 * family + j, changed(prose(family, 150), 10 * family + j, 0.004)) for family in range(3) for j in range(4)]
    assert collected(adaptive_join.similarity_classes(table(spark, rows), Similarity(3, 90))) == brute_classes(rows, Similarity(3, 90))


def test_nothing_to_link(spark):
    assert adaptive_join.similarity_classes(empty(spark), Similarity(3, 90)).collect() == []
    rows = [(1, "a b c d"), (2, "e f g h")]
    assert collected(adaptive_join.similarity_classes(table(spark, rows), Similarity(3, 90))) == [(1, 2, 1), (2, 2, 2)]


def test_stage_keeps_the_first_of_each_class(spark):
    base = prose(3, 200)
    rows = [(4, base), (2, base + " more"), (9, prose(4, 200)), (9, base), (1, None), (None, "x")]
    docs = table(spark, rows)
    kept = adaptive_join.without_near_copies(docs, Similarity(5, 80))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.select("doc_id").collect()) == [0, 1, 2, 9, 9]


def test_components_of_a_path_and_a_star(spark):
    def key(n):
        return n.to_bytes(4, "big")

    pairs = [(key(i), key(i + 1)) for i in range(200)] + [(key(500), key(i)) for i in range(501, 600)]
    labels = adaptive_join.components(spark.createDataFrame(pairs, "a binary, b binary"))
    found = {bytes(r.node): bytes(r.label) for r in labels.collect()}
    assert {found[key(i)] for i in range(201)} == {key(0)}
    assert {found[key(i)] for i in range(500, 600)} == {key(500)}


def test_prefixes_fit_partners():
    for percent in (80, 90):
        s = Similarity(3, percent)
        for n in [*range(1, 2_000), 20_000]:
            d = s.missing(n)
            most = max(1, min((d * 4 * percent) // 1000 + 11, n - d))
            for partner in {-(-n * percent // 100), n, n * 100 // percent}:
                if partner:
                    assert s.kept(partner) >= min(partner, s.missing(partner) + most) or s.missing(partner) + most <= s.kept(partner)
