"""Similarity classes by n-gram Jaccard similarity, through adaptive prefixes with several required matches.

Every document becomes the set of its word shingles, as 64-bit hashes in their own order. If two sets of
similarity t or more are compared, at most d = |x| - ceil(t |x|) elements of x are missing in the other;
so for every l their first d + l elements have at least l in common. Each document is given its own l:
the more postings its plain prefix would probe, the longer the prefix and the more matches it must show.
A document that cannot show them (its shared boilerplate alone is not enough) is out before any pair is
made. What is left, the candidates, is compared with exact sets:

1. Identical sets are one class, whatever their number, and go on as one.
2. ``adaptive``: the filter above, from postings of the first elements only.
3. ``short_pairs``: candidates that meet in lists of at most ``LONG_LIST`` members become pairs if they meet
   often enough, the members' elements in longer lists counting for them. ``families``: connected pairs go to one
   task as long as they are few, so that each set travels once; larger families are verified pair by pair.
4. Candidates whose required matches may all lie in longer lists (large groups of near copies) are the dense
   ones. ``rare_first`` orders their whole sets by rising frequency among themselves and makes lists of plain
   prefixes of d + 1. ``stars``: rounds in which one pivot of each list is verified against the members not yet
   connected to it. ``rest``: every pair still unconnected in some list, so no link is lost; short lists give
   pairs, long ones are cut into cells in which the members outside the list's largest component meet a block
   of all members, so a cell is bounded and only links leave it.

Links are verified by exact set sizes; sets of hashes stand for the sets of shingles. Connected components
come from rounds of smallest labels with short cuts. All intermediate tables are written to the work area.

Defined results: a null text counts as empty; a document without words, or without an id, is linked with
nothing and has itself as component; with fewer words than a shingle has, the whole sequence is the one
shingle; rows that repeat an id are answered one by one by their texts; an empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skylane.llm import word_pieces
from skylane.llm.bit_table import bit_table, holds
from skylane.llm.common import counted, join_answers
from skylane.session import small_side, written, written_counting

# Rounds of pivots over the lists of dense candidates.
PIVOT_ROUNDS = 1
# Lists longer than this are not paired off; those of dense candidates are cut into cells of about two blocks.
LONG_LIST = 64
# Members that meet in one task: so many sets at most, and about so many elements.
BLOCK = 1_024
BLOCK_ELEMENTS = 1_000_000
# Words whose hashes one worker remembers; beyond it the memory is emptied and filled anew. Longer words than
# these are hashed each time, so what is remembered stays below some 40 MB.
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
# Bits of the table that holds back texts which are not asked for.
ASKED_BITS = 26
_MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


_hashes = _WordHashes()


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``words`` words, linked from ``percent`` per cent Jaccard similarity on."""

    words: int
    percent: int

    def missing(self, n: int | Column):
        """How many elements a set of n may lack in a partner; n - ceil(percent n / 100)."""
        if isinstance(n, int):
            return n * (100 - self.percent) // 100
        return F.floor(n * (100 - self.percent) / 100).cast("int")

    def kept(self, n: int) -> int:
        """Elements of which postings are made: a partner's longest prefix must fit, see ``most_matches``."""
        d = self.missing(n)
        return min(n, d + -(-2 * d // 5) + 12)

    def most_matches(self, n: Column, d: Column) -> Column:
        # A partner has at least percent of this size, so it keeps ceil(0.4 d') + 12 >= 0.4 (percent d / 100 - 1) + 12 more.
        cap = F.floor(d * (4 * self.percent) / 1000).cast("int") + 11
        return F.greatest(F.lit(1), F.least(cap, n - d))

    def similar_sizes(self, a: Column, b: Column) -> Column:
        return (F.least(a, b) * 100 >= F.greatest(a, b) * self.percent)

    def linked(self, common: Column, a: Column, b: Column) -> Column:
        return common * 100 >= (a + b - common) * self.percent

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted distinct 64-bit hashes of a text's shingles."""
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not found:
            return np.empty(0, dtype=np.uint64)
        hashed = np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=len(found))
        k = min(self.words, len(found))
        held = np.full(len(found) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            held = (held ^ hashed[j : len(found) - k + 1 + j]) * _MIX[0]
            held ^= held >> np.uint64(29)
            held *= _MIX[1]
            held ^= held >> np.uint64(32)
        return np.unique(held)


def _as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype("int32")
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int64()))


def _sets(rows: DataFrame, similarity: Similarity, asked: np.ndarray | None = None) -> DataFrame:
    """doc_id, node (digest of the set; null without words), n, and the first elements of the set; or, of the rows
    whose id the table of bits ``asked`` may hold, the whole set. No other text is looked at then."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("n", pa.int32()), ("items", pa.list_(pa.int64()))])
    bound = 2_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            columns = [pa.array(keys, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), _lists(items)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        keys, nodes, sizes, items, held = [], [], [], [], 0
        for ids, texts in word_pieces.id_and_text(batches):
            chosen = range(len(ids))
            if asked is not None:
                named = np.array([key is not None for key in ids], dtype=bool)
                chosen = np.flatnonzero(named & holds(asked, np.array([key or 0 for key in ids], dtype=np.int64).view(np.uint64)))
            for i in chosen:
                key, found = ids[i], similarity.shingles(texts[i])
                keys.append(key)
                sizes.append(len(found))
                nodes.append(xxhash.xxh128_digest(found.tobytes()) if len(found) else None)
                items.append(_as_long(found if asked is not None else found[: similarity.kept(len(found))]))
                held += len(items[-1])
                if held >= bound:
                    yield batch()
                    keys, nodes, sizes, items, held = [], [], [], [], 0
        yield batch()

    return rows.mapInArrow(run, "doc_id long, node binary, n int, items array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) of the nodes of undirected ``edges`` (a, b)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = written(lower, "lower")
        # Short cut: the label of one's label, at most as large.
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = lower.join(jump, "label").select("node", "old", F.least("label", "far").alias("label"))
        found, changed = written_counting(step, "labels", F.col("label") != F.col("old"))
        labels = found.select("node", "label")
        if not changed:
            return labels


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left has in common with each on the right."""
    sizes = np.array([len(x) for x in (*left, *right)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, column, counts = np.unique(np.concatenate((*left, *right)), return_inverse=True, return_counts=True)
    several = counts[column] > 1
    row, column = row[several], np.unique(column[several], return_inverse=True)[1]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    # Columns in portions, so that the matrix stays small for long texts; counts below 2^24 are exact.
    for low in range(0, int(column.max(initial=-1)) + 1, 4096):
        chosen = (column >= low) & (column < low + 4096)
        held = np.zeros((len(sizes), 4096), dtype=np.float32)
        held[row[chosen], column[chosen] - low] = 1
        common += held[: len(left)] @ held[len(left) :].T
    return common.astype(np.int64)


def forest(found: list[tuple[int, int]], labels: list) -> list[tuple[int, int]]:
    """The pairs that connect something new, where equal labels are connected from the start."""
    parent: dict = {}

    def root(x):
        while x in parent:
            x = parent[x]
        return x

    out = []
    for i, j in found:
        x, y = root(labels[i]), root(labels[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _linked_sets(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    if len(left) == len(right) == 1:
        common = np.array([[len(np.intersect1d(left[0], right[0], assume_unique=True))]])
    else:
        common = shared_counts(left, right)
    both = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - common
    return [(int(i), int(j)) for i, j in zip(*np.nonzero(common * 100 >= both * percent))]


def _numpy_sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False) for x in column.combine_chunks()]


def family_links(family: pa.Table, percent: int) -> pa.Table:
    """A forest of the links between all rows (node, items) of a small family."""
    nodes, sets = family["node"].to_pylist(), _numpy_sets(family["items"])
    if len(sets) == 2:
        found = [(0, 1)] if _linked_sets(sets[:1], sets[1:], percent) else []
    else:
        found = [(i, j) for i, j in _linked_sets(sets, sets, percent) if i < j]
    links = forest(found, list(range(len(nodes))))
    return pa.table([[nodes[i] for i, _ in links], [nodes[j] for _, j in links]], schema=_LINKS)


def cell_links(cell: pa.Table, percent: int) -> pa.Table:
    """A forest of the links between the asking rows of a cell and its other rows (asks, node, label, items)."""
    asks = cell["asks"].to_pylist()
    order = [i for i, a in enumerate(asks) if a] + [i for i, a in enumerate(asks) if not a]
    asking = sum(asks)
    links: list[tuple[int, int]] = []
    nodes, labels = cell["node"].to_pylist(), cell["label"].to_pylist()
    if 0 < asking < len(order):
        sets = _numpy_sets(cell["items"])
        left, right = [sets[i] for i in order[:asking]], [sets[i] for i in order[asking:]]
        found = [(order[i], order[asking + j]) for i, j in _linked_sets(left, right, percent)]
        links = forest(found, labels)
    return pa.table([[nodes[i] for i, _ in links], [nodes[j] for _, j in links]], schema=_LINKS)


class _Search:
    """One run over one table of documents."""

    def __init__(self, docs: DataFrame, similarity: Similarity):
        self.similarity = similarity
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.rows, self.total = counted(_sets(self.docs, similarity), "prefixes")

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """One row per distinct set (node, n, first_id, size), and the rows that stand for the classes."""
        rows = self.rows.filter("node IS NOT NULL AND doc_id IS NOT NULL")
        classes = written(
            rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n")), "classes"
        )
        # The copies are dropped rather than the first ones looked up: they are few, and the sets stay where they are.
        several = classes.filter("size > 1").select("node", "first_id", "size")
        copies = join_answers(rows.select("doc_id", "node"), several, "node", "size", self.total).filter("doc_id <> first_id")
        copies, count = counted(copies.select("doc_id", "node").distinct(), "copies")
        return classes, rows.join(small_side(copies, count), ["doc_id", "node"], "left_anti")

    def adaptive(self, firsts: DataFrame) -> DataFrame:
        """The classes that show enough shared elements: rep, node, n, doc_id, matches, tokens."""
        # 64 bits are enough to tell classes apart here: two taken for one can only look more alike.
        rep = F.xxhash64("node").alias("rep")
        postings = firsts.select(rep, F.posexplode("items").alias("pos", "token"))
        shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        # Met by sorting at every size, so that small inputs take the way that large ones take.
        live = postings.join(written(shared, "shared").hint("merge"), "token")
        facts = live.groupBy("rep").agg(F.collect_list(F.struct("pos", "df", "token")).alias("live"))
        d = self.similarity.missing(F.col("n"))
        facts = firsts.select("node", "n", "doc_id", rep, d.alias("d")).join(facts, "rep")
        # Postings that the plain prefix would probe.
        cost = F.aggregate("live", F.lit(0).cast("long"), lambda s, p: s + F.when(p["pos"] <= F.col("d"), p["df"] - 1).otherwise(0))
        matches = F.least(self.similarity.most_matches(F.col("n"), F.col("d")).cast("long"), cost + 1)
        facts = facts.withColumn("matches", matches)
        facts = facts.withColumn("live", F.filter("live", lambda p: p["pos"] < F.col("d") + F.col("matches")))
        enough = facts.filter(F.size("live") >= F.col("matches"))
        return written(enough.select("rep", "node", "n", "doc_id", "matches", F.col("live.token").alias("tokens")), "candidates")

    def whole_sets(self, kept: DataFrame) -> DataFrame:
        """rep, node, n, items (the whole set) of the candidates."""
        ids, rows = counted(kept.select("doc_id", "node", "rep"), "candidate-ids")
        # A bounded table of bits holds the other texts back where they are read, so no text is ever shuffled.
        sets = _sets(self.docs, self.similarity, bit_table(ids, "doc_id", ASKED_BITS))
        # Rows that repeat an id may bring other texts along; a set that comes twice changes no result.
        return written(sets.join(small_side(ids, rows), ["doc_id", "node"]).select("rep", "node", "n", "items"), "sets")

    def lists(self, kept: DataFrame) -> DataFrame:
        """token, rep, n, matches, members: the lists with at least two members."""
        rows = kept.select("rep", "n", "matches", F.explode("tokens").alias("token"))
        sizes = rows.groupBy("token").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        return written(rows.join(sizes, "token"), "lists")

    def short_pairs(self, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) of candidates that may be linked and meet in a short list, and the dense candidates."""
        longer = lists.filter(F.col("members") > LONG_LIST).groupBy("rep").agg(F.count(F.lit(1)).alias("longer"), F.first("matches").alias("matches"))
        longer = written(longer, "in-long-lists")
        short = lists.filter(F.col("members") <= LONG_LIST).select("token", "rep", "n", "matches")
        # Both sides carry the same columns, so that they are shuffled once.
        met = short.alias("x").join(short.alias("y"), "token").filter(
            (F.col("x.rep") < F.col("y.rep")) & self.similarity.similar_sizes(F.col("x.n"), F.col("y.n"))
        )
        met = met.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).agg(
            F.count(F.lit(1)).alias("met"), F.first(F.least("x.matches", "y.matches")).alias("needed")
        )
        met = written(met, "met")
        beside = longer.select(F.col("rep").alias("a"), F.col("longer").alias("a_longer"))
        met = met.join(beside, "a", "left").join(beside.toDF("b", "b_longer"), "b", "left")
        hidden = F.least(F.coalesce("a_longer", F.lit(0)), F.coalesce("b_longer", F.lit(0)))
        return written(met.filter(F.col("met") + hidden >= F.col("needed")).select("a", "b"), "pairs"), longer.filter("longer >= matches").select("rep")

    def families(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Links among the pairs: families of at most a block in one task each, larger ones pair by pair."""
        family = components(pairs).select(F.col("node").alias("rep"), F.col("label").alias("family"))
        named = sets.select("rep", "node", "n")
        sizes = family.join(named, "rep").groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("elements"))
        one_task = (F.col("members") <= BLOCK) & (F.col("elements") <= BLOCK_ELEMENTS)
        family, rows = written_counting(family.join(sizes.select("family", one_task.alias("one_task")), "family"), "families", F.col("one_task"))
        percent = self.similarity.percent
        # Where the families are counted small they go to the sets, which then travel once, to their family.
        small = sets.join(small_side(family.filter("one_task").select("rep", "family"), rows), "rep").select("family", "node", "items")
        together = small.groupBy("family").applyInArrow(lambda t: family_links(t, percent), "a binary, b binary")
        large = family.filter("NOT one_task").select(F.col("rep").alias("a"))
        named = named.select("rep", "node")
        apart = pairs.join(large, "a", "left_semi").join(named.toDF("a", "node_a"), "a").join(named.toDF("b", "node_b"), "b")
        return written(together, "family-links").union(self.verified(apart.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), sets))

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes that are linked."""
        pairs, _ = counted(pairs.select("a", "b").distinct(), "asked-pairs")
        nodes, rows = counted(pairs.select("a").union(pairs.select("b")).distinct().toDF("node"), "asked-nodes")
        # Sets that no pair asks for stay where they are.
        asked = sets.join(small_side(nodes, rows), "node", "left_semi")
        left = asked.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("items").alias("of_a"))
        right = asked.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("items").alias("of_b"))
        common = F.size(F.array_intersect("of_a", "of_b"))
        joined = pairs.join(left, "a").join(right, "b")
        return written(joined.filter(self.similarity.linked(common, F.col("an"), F.col("bn"))).select("a", "b"), "links")

    def mixed(self, lists: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
        """The lists' rows with their labels, where a list has more than one."""
        own = lists.select("token", "node", "n").join(labels, "node", "left").select("token", "node", "n", F.coalesce("label", "node").alias("label"))
        own = written(own, "labelled-lists")
        apart = own.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
        return written_counting(own.join(apart.select("token"), "token"), "mixed", F.lit(True))

    def stars(self, lists: DataFrame, sets: DataFrame, links: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rounds of pivots; returns links and labels."""
        for round_ in range(PIVOT_ROUNDS):
            lists, rows = self.mixed(lists, labels)
            if not rows:
                break
            order = F.struct(F.xxhash64("node", F.lit(round_)).alias("by"), F.col("node").alias("a"), F.col("label").alias("of"), F.col("n").alias("an"))
            pivots = lists.groupBy("token").agg(F.min(order).alias("pivot"))
            met = lists.join(pivots, "token").select(F.col("pivot.a").alias("p"), F.col("pivot.of").alias("of"), F.col("pivot.an").alias("an"), "node", "n", "label")
            met = met.filter((F.col("of") != F.col("label")) & self.similarity.similar_sizes(F.col("an"), F.col("n")))
            links = links.union(self.verified(met.select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")), sets))
            labels = components(links)
        return links, labels

    def rare_first(self, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Lists (token, node, n) of the plain prefixes in order of rising frequency among ``sets``, and for
        each node the number of its elements that others have too."""
        items = sets.select("node", "n", F.explode("items").alias("token"))
        frequent = items.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        shared = items.join(frequent, "token")
        # Elements that no other has come first in the order, and fill the prefix by themselves.
        by_node = W.partitionBy("node")
        ranked = shared.withColumn("common", F.count(F.lit(1)).over(by_node)).withColumn(
            "place", F.row_number().over(by_node.orderBy("df", "token")) + F.col("n") - F.col("common")
        )
        prefix = written(ranked.filter(F.col("place") <= self.similarity.missing(F.col("n")) + 1).select("token", "node", "n", "common"), "rare-first")
        return prefix.select("token", "node", "n"), written(prefix.groupBy("node").agg(F.first("common").alias("common")), "commons")

    def rest(self, lists: DataFrame, commons: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame | None:
        """Links between members of lists that are still mixed."""
        lists, rows = self.mixed(lists, labels)
        if not rows:
            return None
        lists = lists.join(commons, "node")
        by_label = lists.groupBy("token", "label").agg(F.count(F.lit(1)).alias("held"), F.max("n").alias("widest"), F.min("n").alias("least"))
        most = F.max(F.struct("held", "label")).alias("most")
        sizes = by_label.groupBy("token").agg(F.sum("held").alias("members"), most, F.max("widest").alias("widest"), F.min("least").alias("least"))
        block = F.greatest(F.lit(16), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_ELEMENTS) / F.col("widest"))))
        sizes = sizes.select("token", "members", "least", block.alias("block_size"), F.col("most.label").alias("main"), (F.col("members") - F.col("most.held")).alias("outside"))
        sizes = written(sizes, "list-sizes")
        lists = written(lists.join(sizes, "token"), "sized-lists")
        short = lists.filter(F.col("members") <= LONG_LIST).select("token", "node", "n", "label", "common")
        other = short.select("token", *[F.col(c).alias(f"o_{c}") for c in ("node", "n", "label", "common")])
        # Neither can share more than its elements that somebody else has.
        possible = self.similarity.linked(F.least("common", "o_common"), F.col("n"), F.col("o_n"))
        met = short.join(other, "token").filter((F.col("node") < F.col("o_node")) & (F.col("label") != F.col("o_label")) & possible)
        links = self.verified(met.select(F.col("node").alias("a"), F.col("o_node").alias("b")), sets)
        return links.union(written(self.in_cells(lists.filter(F.col("members") > LONG_LIST), sets), "cell-links"))

    def in_cells(self, lists: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between the members of a long list outside its main component and all its members."""

        def blocks(rows: Column) -> Column:
            return F.ceil(rows / F.col("block_size")).cast("int")

        def every(count: Column) -> Column:
            return F.sequence(F.lit(0), count - 1)

        # A node is out if it could not be linked even with all its common elements shared. The best partner has
        # nothing else, so it may be smaller than the node, but not smaller than the list's smallest member.
        partner = F.greatest("common", "least")
        able = lists.filter(self.similarity.linked(F.col("common"), F.col("n"), partner)).join(sets.select("node", "items"), "node")
        place = F.xxhash64("node")
        member = able.select(
            "token",
            F.pmod(place, blocks(F.col("members"))).alias("block"),
            F.explode(every(blocks(F.col("outside")))).alias("chunk"),
            F.lit(False).alias("asks"),
            "node",
            "label",
            "items",
        )
        outside = able.filter("label <> main").select(
            "token",
            F.explode(every(blocks(F.col("members")))).alias("block"),
            F.pmod(place, blocks(F.col("outside"))).alias("chunk"),
            F.lit(True).alias("asks"),
            "node",
            "label",
            "items",
        )
        percent = self.similarity.percent
        cells = member.union(outside).groupBy("token", "block", "chunk")
        return cells.applyInArrow(lambda t: cell_links(t, percent), "a binary, b binary")

    def run(self) -> DataFrame:
        classes, firsts = self.classes()
        kept = self.adaptive(firsts)
        sets = self.whole_sets(kept)
        pairs, dense = self.short_pairs(self.lists(kept))
        links = self.families(pairs, sets)
        labels = components(links)
        if not dense.isEmpty():
            dense_sets = written(sets.join(dense, "rep", "left_semi"), "dense-sets")
            lists, commons = self.rare_first(dense_sets)
            links, labels = self.stars(lists, dense_sets, links, labels)
            more = self.rest(lists, commons, dense_sets, labels)
            if more is not None:
                labels = components(links.union(more))
        # Per component the smallest id, and per class its component.
        facts = classes.select("node", "first_id", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        facts = written(facts, "labelled-classes")
        smallest = facts.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("classes"))
        answers = written(join_answers(facts, smallest, "label", "classes", self.total).select("node", "component_id", "size"), "components")
        alone = self.rows.filter("node IS NULL OR doc_id IS NULL").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        rows = self.rows.filter("node IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "n", "node")
        linked = join_answers(rows, answers, "node", "size", self.total)
        return alone.union(linked.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id"))


def similarity_classes(docs: DataFrame, similarity: Similarity) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return _Search(docs, similarity).run()


def without_near_copies(docs: DataFrame, similarity: Similarity) -> DataFrame:
    """One document of each class, the one with the smallest id, with all its columns.

    Where rows of different texts share an id, all stay as long as one of them is the first of its class.
    """
    found = similarity_classes(docs, similarity).filter("doc_id IS NOT NULL")
    stays = found.groupBy(F.col("doc_id").alias("_dropped_id")).agg(F.bool_or(F.col("component_id") == F.col("doc_id")).alias("_stays"))
    dropped = stays.filter(~F.col("_stays")).select("_dropped_id")
    return docs.join(dropped, docs["doc_id"] == dropped["_dropped_id"], "left_anti")


# The same rows for the query's similarity, for a check outside Spark.
SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END)) AS sh FROM w),
c AS MATERIALIZED (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
t AS MATERIALIZED (SELECT rep, n, unnest(sh) AS tok FROM c),
f AS MATERIALIZED (SELECT rep, n, tok FROM t WHERE tok IN (SELECT tok FROM t GROUP BY tok HAVING count(*) > 1)),
p AS MATERIALIZED (
  SELECT a.rep AS x, b.rep AS y FROM f a JOIN f b ON a.tok = b.tok AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT x, y FROM p UNION SELECT y, x FROM p),
r AS (SELECT rep AS x, rep AS y FROM c UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
k AS MATERIALIZED (SELECT x AS rep, min(y) AS component_id FROM r GROUP BY x)
SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.sh = s.sh LEFT JOIN k ON k.rep = c.rep
"""
