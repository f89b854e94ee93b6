"""Near copies by b-bit minwise signatures and a multi-index Hamming join.

A document is the set of its word shingles. Its signature holds, for each of ``symbols`` hash functions, the lowest
16 bits of the set's minimum; two sets of Jaccard similarity s differ in about a share 1 - s of the symbols. Pairs at
the limit differ in at most ``radius`` symbols but for one in ten thousand (four standard deviations), more similar
pairs practically always.

1. ``classes``: identical sets are one class and go on as one.
2. ``shared_keys``: the signature is cut into chunks. By the pigeonhole principle two signatures with ``radius``
   differences at most agree in some chunk but for the errors allowed to it, where allowed errors and chunks add up
   to ``radius + 1``. Each way of placing a chunk's errors gives one key, of the symbols that are left; so every such
   pair has a key in common. Keys of one class only are dropped.
3. ``near``: pairs within the radius, as far as they connect something. First each member of a list with one pivot;
   then, in lists whose members are not yet connected, all pairs of short lists, and long ones in cells of two
   blocks, which give connecting pairs only. What is connected is a family; no pair within the radius is outside.
4. ``links``: the sets are made again from the texts of the families alone (a bounded table of bits over ids
   holds the others back where they are read, so texts are never shuffled). All pairs of a family of at most ``BLOCK`` sets
   are compared in one task. A larger one is compared block by block with eight pivots, then those outside its
   largest component in cells with all members. A link is confirmed on the full sets; cells give connecting links.
5. Connected components, and the smallest id of each.

Sets stand as 64-bit hashes, of shingles and of whole sets; two of m sets are taken for one with odds of m * m / 2**65.

Defined results: a null text counts as empty; a document without words, or without an id, is linked with nothing, has
itself as component and is kept; with fewer words than a shingle has, the whole sequence is the one shingle; rows
that repeat an id are answered one by one by their texts; an empty table gives no rows. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.llm import word_pieces
from skylane.llm.adaptive_join import Similarity, components, shared_counts
from skylane.llm.bit_table import bit_table, holds
from skylane.llm.common import counted, join_answers
from skylane.session import written

# Lists longer than this are not paired off.
LONG_LIST = 64
# Members that meet in one task: so many at most, and about so many elements.
BLOCK = 256
BLOCK_ELEMENTS = 400_000
# Members of a large family that all others are compared with first.
PIVOTS = 8
FAMILY_BITS = 26


@dataclass(frozen=True)
class Signatures:
    """``symbols`` symbols of 16 bits, searched in chunks of about ``chunk`` symbols."""

    similarity: Similarity
    symbols: int = 128
    chunk: int = 5

    @property
    def radius(self) -> int:
        unlike = (100 - self.similarity.percent) / 100
        return ceil(self.symbols * unlike + 4 * sqrt(self.symbols * unlike * (1 - unlike)))

    def chunks(self) -> list[tuple[int, int, int]]:
        """begin, size, errors allowed of each chunk; sizes plus one another differ by one at most."""
        number = self.symbols // self.chunk
        edges = [self.symbols * i // number for i in range(number + 1)]
        allowed, more = divmod(self.radius + 1, number)
        return [(a, b - a, allowed - 1 + (i < more)) for i, (a, b) in enumerate(zip(edges, edges[1:]))]

    def kept_places(self) -> list[tuple[int, ...]]:
        """The symbols of each key; a chunk to which not even agreement is owed has none."""
        return [
            tuple(begin + i for i in range(size) if i not in left_out)
            for begin, size, errors in self.chunks()
            if errors >= 0
            for left_out in combinations(range(size), min(errors, size))
        ]

    def keys(self, signature: Column) -> Column:
        """The array of a signature's keys."""

        def key(number: int, places: tuple[int, ...]) -> Column:
            parts, begin = [], 0
            for i in range(1, len(places) + 1):
                if i == len(places) or places[i] != places[i - 1] + 1:
                    parts.append(F.substring(signature, 2 * places[begin] + 1, 2 * (i - begin)))
                    begin = i
            return F.xxhash64(F.lit(number), *parts)

        return F.array(*[key(i, p) for i, p in enumerate(self.kept_places())])

    def constants(self) -> tuple[np.ndarray, np.ndarray]:
        drawn = np.random.default_rng(self.symbols).integers(0, 2**32, (2, self.symbols), dtype=np.uint32)
        return drawn[0], drawn[1] | np.uint32(1)

    def of(self, shingles: np.ndarray) -> bytes:
        """The signature of a set of 64-bit hashes."""
        masks, factors = self.constants()
        small = (shingles >> np.uint64(17)).astype(np.uint32)[:, None]
        least = np.full(self.symbols, 2**32 - 1, dtype=np.uint32)
        for low in range(0, len(small), 512):
            mixed = (small[low : low + 512] ^ masks) * factors
            np.minimum(least, mixed.min(axis=0), out=least)
        # The minimum's upper bits say little; its product's are spread evenly.
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def _node(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes()))))


def _signed(docs: DataFrame, signatures: Signatures) -> DataFrame:
    """doc_id, node (hash of the set; null without words), n, signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in word_pieces.id_and_text(batches):
            rows = []
            for key, text in zip(ids, texts):
                found = signatures.similarity.shingles(text)
                rows.append((key, _node(found), len(found), signatures.of(found)) if len(found) else (key, None, 0, None))
            yield word_pieces.arrow_batch(schema, list(zip(*rows)) if rows else [()] * 4)

    return docs.mapInArrow(run, "doc_id long, node long, n int, signature binary")


def _whole_sets(docs: DataFrame, similarity: Similarity, asked: np.ndarray) -> DataFrame:
    """node, doc_id, items of the documents whose id the table of bits may hold; no other text is looked at."""
    schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for ids, texts in word_pieces.id_and_text(batches):
            named = np.array([key is not None for key in ids])
            hashes = np.array([key or 0 for key in ids], dtype=np.int64).view(np.uint64)
            for i in np.flatnonzero(named & holds(asked, hashes)) if ids else ():
                found = similarity.shingles(texts[i])
                if len(found):
                    rows.append((_node(found), ids[i], found.view(np.int64)))
                    held += len(found)
                if held >= BLOCK_ELEMENTS:
                    yield word_pieces.arrow_batch(schema, list(zip(*rows)))
                    rows, held = [], 0
        if rows:
            yield word_pieces.arrow_batch(schema, list(zip(*rows)))

    return docs.mapInArrow(run, "node long, doc_id long, items array<long>")


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, width)


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each set on the left is linked with each on the right, by the full sets."""
    common = shared_counts(left, right)
    both = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - common
    return common * 100 >= both * percent


def connecting(labels: np.ndarray, left: np.ndarray, right: np.ndarray, met: Iterator[np.ndarray]) -> list[tuple[int, int]]:
    """A forest of the pairs (left, right) that ``met`` marks, row by row, where equal labels are connected already."""
    groups, found = np.unique(labels, return_inverse=True)[1], []
    for i, row in zip(left, met):
        partners = right[row]
        others, first = np.unique(groups[partners], return_index=True)
        for group, at in zip(others, first):
            if group != groups[i]:
                found.append((i, partners[at]))
                groups[groups == group] = groups[i]
    return found


def _edges(nodes: np.ndarray, pairs: list[tuple[int, int]]) -> pa.Table:
    a, b = (nodes[[p[side] for p in pairs]].astype(np.int64) if pairs else np.empty(0, np.int64) for side in (0, 1))
    return pa.table({"a": a, "b": b})


def _numpy_sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False) for x in column]


def families_links(held: pa.Table, percent: int) -> pa.Table:
    """A forest of the links in each of several small families (family, node, items)."""
    family, nodes = held["family"].to_numpy(), held["node"].to_numpy()
    order = np.lexsort((nodes, family))
    # A row that is there twice is compared once.
    order = order[np.concatenate(([True], (nodes[order][1:] != nodes[order][:-1])))] if len(order) else order
    sets, found = _numpy_sets(held["items"]), []
    edges = np.flatnonzero(np.concatenate(([True], family[order][1:] != family[order][:-1], [True])))
    for low, high in zip(edges, edges[1:]):
        members = order[low:high]
        if len(members) > 1:
            own = [sets[i] for i in members]
            places = np.arange(len(members))
            found += [(members[i], members[j]) for i, j in connecting(places, places, places, _linked(own, own, percent))]
    return _edges(nodes, found)


def _sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    asks = cell["asks"].to_numpy(zero_copy_only=False)
    return cell["node"].to_numpy(), cell["label"].to_numpy(), np.flatnonzero(asks), np.flatnonzero(~asks)


def cell_links(cell: pa.Table, percent: int) -> pa.Table:
    """A forest of the links between the asking rows of a cell and its other ones (asks, node, label, items)."""
    nodes, labels, left, right = _sides(cell)
    if not len(left) or not len(right):
        return _edges(nodes, [])
    sets = _numpy_sets(cell["items"])
    return _edges(nodes, connecting(labels, left, right, _linked([sets[i] for i in left], [sets[j] for j in right], percent)))


def cell_near(cell: pa.Table, width: int, radius: int) -> pa.Table:
    """A forest of the pairs within the radius between asking rows and others (asks, node, label, signature)."""
    nodes, labels, left, right = _sides(cell)
    if not len(left) or not len(right):
        return _edges(nodes, [])
    signatures = _matrix(cell["signature"], width)
    others = signatures[right]
    return _edges(nodes, connecting(labels, left, right, ((others != signatures[i]).sum(axis=1) <= radius for i in left)))


def _every(count: Column) -> Column:
    return F.sequence(F.lit(0), count - 1)


def _blocks(rows: str) -> Column:
    return F.ceil(F.col(rows) / F.col("block_size")).cast("int")


def _cells(rows: DataFrame, group: str, carried: str) -> DataFrame:
    """Members that lie outside their group's main label, in cells with all members of their group."""
    place = F.xxhash64("node")
    kept = ["node", "label", carried]
    member = rows.select(group, F.pmod(place, _blocks("members")).alias("block"), F.explode(_every(_blocks("outside"))).alias("chunk"), F.lit(False).alias("asks"), *kept)
    asking = rows.filter("label <> main").select(
        group, F.explode(_every(_blocks("members"))).alias("block"), F.pmod(place, _blocks("outside")).alias("chunk"), F.lit(True).alias("asks"), *kept
    )
    return member.union(asking).groupBy(group, "block", "chunk")


def _sizes(rows: DataFrame, group: str, block: Column) -> DataFrame:
    """Per group with more than one label: members, main (its most frequent label), outside, block_size."""
    by_label = rows.groupBy(group, "label").agg(F.count(F.lit(1)).alias("held"), F.max("n").alias("n"))
    sizes = by_label.groupBy(group).agg(F.sum("held").alias("members"), F.max(F.struct("held", "label")).alias("most"), F.max("n").alias("widest"))
    sizes = sizes.select(group, "members", F.col("most.label").alias("main"), (F.col("members") - F.col("most.held")).alias("outside"), block.alias("block_size"))
    return written(sizes.filter("outside > 0"), "group-sizes")


class _Join:
    """One run over one table of documents."""

    def __init__(self, docs: DataFrame, signatures: Signatures):
        self.signatures, self.similarity = signatures, signatures.similarity
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.rows, self.total = counted(_signed(self.docs, signatures), "signed")
        self.classes = self.of_classes()

    def of_classes(self) -> DataFrame:
        """One row per distinct set: node, first_id, size, n, signature."""
        rows = self.rows.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node")
        facts = [F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("signature").alias("signature")]
        return written(rows.agg(*facts), "classes")

    def shared_keys(self) -> DataFrame:
        """key, node, members, pivot: the lists of the keys that several classes have."""
        postings = self.classes.select("node", F.explode(self.signatures.keys(F.col("signature"))).alias("key"))
        lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("pivot")).filter("members > 1")
        total = self.total * len(self.signatures.kept_places())
        return written(join_answers(postings, written(lists, "lists"), "key", "members", total), "postings")

    def within(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose signatures are within the radius."""
        width, radius = self.signatures.symbols, self.signatures.radius
        pairs, rows = counted(pairs.select("a", "b").distinct(), "asked-pairs")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                differ = (_matrix(batch.column(2), width) != _matrix(batch.column(3), width)).sum(axis=1)
                yield batch.select([0, 1]).filter(pa.array(differ <= radius))

        signed = self.classes.select("node", "signature")
        asked = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("held")).join(signed.toDF("a", "of_a"), "a")
        both = join_answers(pairs, written(asked, "asked"), "a", "held", rows).join(signed.toDF("b", "of_b"), "b")
        return written(both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long"), "near")

    def near(self) -> DataFrame:
        """Pairs within the radius (a, b) that connect all that such pairs connect."""
        lists = self.shared_keys()
        stars = self.within(lists.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        own = lists.join(components(stars), "node", "left").withColumn("label", F.coalesce("label", "node")).drop("pivot")
        own = written(own.withColumn("n", F.lit(1)), "labelled-lists")
        sizes = _sizes(own, "key", F.lit(4 * BLOCK))
        mixed = written(own.drop("members", "n").join(sizes, "key"), "mixed-lists")
        short = mixed.filter(F.col("members") <= LONG_LIST).select("key", "node", "label")
        met = short.join(short.toDF("key", "other", "of"), "key").filter((F.col("node") < F.col("other")) & (F.col("label") != F.col("of")))
        pairs = self.within(met.select(F.col("node").alias("a"), F.col("other").alias("b")))
        long = mixed.filter(F.col("members") > LONG_LIST).join(self.classes.select("node", "signature"), "node")
        width, radius = self.signatures.symbols, self.signatures.radius
        cells = _cells(long, "key", "signature").applyInArrow(lambda t: cell_near(t, width, radius), "a long, b long")
        return stars.union(pairs).union(written(cells, "near-in-cells"))

    def sets(self, members: DataFrame) -> DataFrame:
        """The members (node, first_id and more) with their whole sets."""
        asked = bit_table(members, "first_id", FAMILY_BITS)
        held = _whole_sets(self.docs, self.similarity, asked).withColumnRenamed("doc_id", "first_id")
        return held.join(members, ["node", "first_id"])

    def links(self, near: DataFrame) -> DataFrame:
        """Links (a, b), confirmed on full sets, that connect all that is linked within families."""
        percent = self.similarity.percent
        family = components(near).withColumnRenamed("label", "family").join(self.classes.select("node", "first_id", "n"), "node")
        family = written(family, "families")
        sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("elements"), F.max("n").alias("widest"))
        large = (F.col("members") > BLOCK) | (F.col("elements") > BLOCK_ELEMENTS)
        sizes = written(sizes.withColumn("large", large), "family-sizes")
        elements = sizes.filter("NOT large").agg(F.coalesce(F.sum("elements"), F.lit(0))).first()[0]
        # Each task takes several small families, of about two blocks together.
        dealt = F.pmod(F.xxhash64("family"), F.lit(max(1, elements // (2 * BLOCK_ELEMENTS)))).alias("dealt")
        small = self.sets(family.join(sizes.filter("NOT large").select("family"), "family").select("node", "first_id", "family", dealt))
        found = written(small.groupBy("dealt").applyInArrow(lambda t: families_links(t, percent), "a long, b long"), "family-links")
        rest = family.join(sizes.filter("large").select("family", "members", "widest"), "family")
        return found if rest.isEmpty() else found.union(self.large_links(rest))

    def large_links(self, rest: DataFrame) -> DataFrame:
        """Links in large families: with pivots, then between what they left outside and all members."""
        percent = self.similarity.percent
        block = F.greatest(F.lit(16), F.least(F.lit(4 * BLOCK), F.floor(F.lit(BLOCK_ELEMENTS) / F.col("widest"))))
        held = written(self.sets(rest.withColumn("block_size", block)), "large-families")
        pivots = rest.groupBy("family", F.pmod(F.xxhash64("node"), F.lit(PIVOTS))).agg(F.min("node").alias("node"))
        members = held.select("family", F.pmod(F.xxhash64("node"), _blocks("members")).alias("block"), F.lit(False).alias("asks"), "node", F.col("node").alias("label"), "items")
        asking = held.join(F.broadcast(pivots) if pivots.count() <= 10_000 else pivots, ["family", "node"]).select(
            "family", F.explode(_every(_blocks("members"))).alias("block"), F.lit(True).alias("asks"), "node", F.col("node").alias("label"), "items"
        )
        cells = members.union(asking).groupBy("family", "block")
        found = written(cells.applyInArrow(lambda t: cell_links(t, percent), "a long, b long"), "pivot-links")
        own = held.select("family", "node", F.size("items").alias("n")).join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node"))
        own = written(own, "labelled-families")
        sizes = _sizes(own, "family", block)
        able = held.select("node", "items").join(own.drop("n").join(sizes, "family"), "node")
        cells = _cells(able, "family", "items").applyInArrow(lambda t: cell_links(t, percent), "a long, b long")
        return found.union(written(cells, "cell-links"))

    def run(self) -> DataFrame:
        labels = components(self.links(self.near()))
        facts = self.classes.select("node", "first_id", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        facts = written(facts, "labelled-classes")
        smallest = facts.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("held"))
        answers = written(join_answers(facts, written(smallest, "smallest"), "label", "held", self.total).select("node", "component_id", "size"), "components")
        shown = ["doc_id", F.col("n").cast("long").alias("n_shingles")]
        alone = self.rows.filter("node IS NULL OR doc_id IS NULL").select(*shown, F.col("doc_id").alias("component_id"))
        linked = join_answers(self.rows.filter("node IS NOT NULL AND doc_id IS NOT NULL").drop("signature"), answers, "node", "size", self.total)
        found = alone.union(linked.select(*shown, "component_id"))
        return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_copies(docs: DataFrame, signatures: Signatures) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    return _Join(docs, signatures).run()


# The same rows for five words and 85 per cent, for a check outside Spark.
SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS held FROM words),
classes AS MATERIALIZED (SELECT held, min(doc_id) AS first_id, len(held) AS n FROM sets WHERE len(held) > 0 GROUP BY held),
items AS MATERIALIZED (SELECT first_id, n, unnest(held) AS item FROM classes),
shared AS MATERIALIZED (SELECT first_id, n, item FROM items WHERE item IN (SELECT item FROM items GROUP BY item HAVING count(*) > 1)),
pairs AS MATERIALIZED (
  SELECT a.first_id AS x, b.first_id AS y FROM shared a JOIN shared b ON a.item = b.item AND a.first_id < b.first_id
  GROUP BY a.first_id, b.first_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS MATERIALIZED (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reached AS (SELECT first_id AS x, first_id AS y FROM classes UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y),
found AS MATERIALIZED (SELECT x, min(y) AS component_id FROM reached GROUP BY x)
SELECT s.doc_id, len(s.held) AS n_shingles, coalesce(f.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(f.component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON c.held = s.held LEFT JOIN found f ON f.x = c.first_id
"""
