"""Phrases that are more than their words, counted in depth-truncated suffix trees that are built apart.

The texts of a language are one long sequence of words, cut into pieces at punctuation and line ends. Every word
begins a suffix, truncated at ``DEPTH`` words and at its piece's end. The tree of all suffixes is too large to be
built at once, so it is partitioned vertically, by the words that a suffix begins with:

1. ``word_counts``: how often each word occurs (prefixes of one word), exactly.
2. ``pair_counts``: how often each prefix of two frequent words occurs, by hash. A prefix with fewer than ``least``
   occurrences has no candidate below it, so suffixes are cut before it (tested by a bounded table of bits over the
   hashes; it can only keep too much). Prefixes with more occurrences than a share of ``BUDGET`` are extended: from
   one word to two, and from there to the whole suffix.
3. ``trees``: prefixes are dealt to groups of about half of ``BUDGET`` suffixes. Each task counts its own equal
   suffixes first; a group's rows then meet in one task, which sorts them, reads off the subtree's nodes and sums
   each node's leaves. Nodes above an extended prefix get a share from several groups and are added up after.
4. ``ranked``: all cuts of a phrase are frequent themselves, so their counts are looked up among the nodes.

Counts cover all texts and are exact; a hash only decides how far a suffix is kept and to which group it goes.

Defined results: a null or empty text has no words; a null lang counts as ``und``; equal rows count as often as they
are there; ids play no part; an empty table gives no rows. Other columns are ignored, whatever their names.
Characters that are not valid in UTF-8 (lone surrogates) count as U+FFFD.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skylane.llm.bit_table import bit_table, holds
from skylane.llm.common import counted, text_of
from skylane.session import small_side, written

DEPTH = 4
# Suffixes that one group holds at most, but for chance; prefixes with more than an eighth of it are extended.
BUDGET = 1_000_000
# Bytes of text that a task counts together before it sends counts on, and suffixes that it spells out at a time.
PORTION = 6_000_000
SPELLED = 50_000
WORD_BITS, PAIR_BITS, HEAVY_BITS = 24, 26, 20
# Splits of a language in which its best phrases are sought first.
RANK_SPLITS = 32

_BREAK = b"\n"
# A-Z become small, the characters that end pieces a line feed, a tab a blank.
_LETTERS = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09",
    b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ",
)


class _Words:
    """The words of some texts of one language, as numbers in the order of the texts; -1 ends a piece."""

    def __init__(self, texts: list[bytes]):
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        numbers[_BREAK], numbers[b""]  # 0 and 1
        shown = _BREAK.join(texts).translate(_LETTERS).replace(_BREAK, b" \n ").split(b" ")
        order = np.fromiter(map(numbers.__getitem__, shown), dtype=np.int32, count=len(shown))
        self.order = order[order != 1] - 2
        self.order[self.order < 0] = -1
        self.words = list(numbers)[2:]

    def hashes(self, lang: str) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"))
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), dtype=np.uint64, count=len(self.words))


def joined_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in their order."""
    h = (first ^ (first >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + second
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _parts(text: str) -> Iterator[bytes]:
    """A text as bytes, a very long one in parts that end where a piece does, if pieces end at all."""
    held = text.encode("utf-8", "replace")
    while len(held) > PORTION:
        cut = max(held.rfind(c, 0, PORTION) for c in (b"\n", b".", b",", b";", b":", b"!", b"?"))
        if cut < 0:
            break
        yield held[: cut + 1]
        held = held[cut + 1 :]
    yield held


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Words]]:
    """The words of a task's texts by language, some megabytes at a time."""
    texts, held = defaultdict(list), 0
    for batch in batches:
        # Row by row: the texts of a whole batch beside their bytes would be held twice.
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang = lang.as_py()
            for part in _parts(text.as_py()):
                texts[lang].append(part)
                held += len(part)
                if held >= PORTION:
                    yield from ((k, _Words(v)) for k, v in texts.items())
                    texts, held = defaultdict(list), 0
    yield from ((k, _Words(v)) for k, v in texts.items())


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _of_lang(lang: str, size: int) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(np.zeros(size, dtype=np.int32)), pa.array([lang])).cast(pa.string())


def shown(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, f, hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, held in _portions(batches):
            f = np.bincount(held.order[held.order >= 0], minlength=len(held.words))
            columns = [_of_lang(lang, len(f)), _strings(held.words), pa.array(f), pa.array(held.hashes(lang).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "f", "hash"])

    rows = texts.mapInArrow(run, "lang string, word string, f long, hash long")
    return written(rows.groupBy("lang", "word").agg(F.sum("f").alias("f"), F.min("hash").alias("hash")), "words")


def pair_counts(texts: DataFrame, frequent: np.ndarray, least: int) -> DataFrame:
    """hash, f of the prefixes of two frequent words that occur ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, held in _portions(batches):
            hashes = held.hashes(lang)
            stays = np.append(holds(frequent, hashes), False)
            a, b = held.order[:-1], held.order[1:]
            both = stays[a] & stays[b]
            pairs, f = np.unique(a[both].astype(np.int64) * len(hashes) + b[both], return_counts=True)
            if len(pairs):
                h = joined_hash(hashes[pairs // len(hashes)], hashes[pairs % len(hashes)])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f)], names=["hash", "f"])

    rows = texts.mapInArrow(run, "hash long, f long")
    return written(rows.groupBy("hash").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "pairs")


def _counted_ways(order: np.ndarray, hashes: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different suffixes of a portion as rows of word numbers (-1 after the end), and how often each occurs."""
    padded = np.concatenate((order, np.full(DEPTH, -1, dtype=np.int32)))
    goes_on = (padded[:-1] >= 0) & (padded[1:] >= 0)
    for low in range(0, len(goes_on), SPELLED):
        on = goes_on[low : low + SPELLED]
        at = low + np.flatnonzero(on)
        on[on] = holds(pairs, joined_hash(hashes[padded[at]], hashes[padded[at + 1]]))
    begins = np.flatnonzero(goes_on[: len(order)])
    # Two numbers a row are sorted faster than four.
    width = len(hashes) + 1
    keys = []
    stays = np.ones(len(begins), dtype=bool)
    for k in range(DEPTH):
        if k:
            stays &= goes_on[begins + (k - 1)]
        way = np.where(stays, padded[begins + k], np.int32(-1)).astype(np.int64) + 1
        keys = [*keys, way * width] if k % 2 == 0 else [*keys[:-1], keys[-1] + way]
    del begins, stays, way, padded, goes_on
    places = np.lexsort(keys[::-1])
    keys = [key[places] for key in keys]
    del places
    changes = np.ones(len(keys[0]), dtype=bool)
    changes[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
    starts = np.flatnonzero(changes)
    ways = np.empty((len(starts), DEPTH), dtype=np.int32)
    for k, key in enumerate(keys):
        key = key[starts]
        ways[:, 2 * k], ways[:, 2 * k + 1] = key // width - 1, key % width - 1
    return ways, np.diff(np.append(starts, len(changes)))


def suffixes(texts: DataFrame, pairs: np.ndarray, heavy_words: np.ndarray, heavy_pairs: np.ndarray, groups: int) -> DataFrame:
    """group_id, lang, suffix (two to four words), prefix (words of it that chose the group), f."""
    schema = pa.schema([("group_id", pa.int32()), ("lang", pa.string()), ("suffix", pa.string()), ("prefix", pa.int32()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, held in _portions(batches):
            hashes = held.hashes(lang)
            if not len(hashes):
                continue
            ways, f = _counted_ways(held.order, hashes, pairs)
            words = _strings(held.words)
            for low in range(0, len(f), SPELLED):
                yield spelled(lang, hashes, words, ways[low : low + SPELLED], f[low : low + SPELLED])

    def spelled(lang: str, hashes: np.ndarray, words: pa.Array, ways: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        depth = (ways >= 0).sum(axis=1)
        by = hashes[ways[:, 0]]
        pair = joined_hash(by, hashes[ways[:, 1]])
        prefix = np.where(~holds(heavy_words, by), 1, np.where(~holds(heavy_pairs, pair), 2, DEPTH))
        by = np.where(prefix >= 2, pair, by)
        for k in (2, 3):
            longer = (prefix > k) & (depth > k)
            by[longer] = joined_hash(by[longer], hashes[ways[longer, k]])
        columns = [words.take(pa.array(ways[:, k], mask=ways[:, k] < 0)) for k in range(DEPTH)]
        suffix = pc.binary_join_element_wise(*columns, " ", null_handling="skip")
        group = ((by >> np.uint64(20)) % np.uint64(groups)).astype(np.int32)
        made = [pa.array(group), _of_lang(lang, len(f)), suffix, pa.array(prefix.astype(np.int32)), pa.array(f)]
        return pa.RecordBatch.from_arrays(made, schema=schema)

    return texts.mapInArrow(run, "group_id int, lang string, suffix string, prefix int, f long")


def subtree(group: pa.Table) -> pa.Table:
    """The nodes of a group's tree: lang, phrase, f (the sum of its leaves), whole (no other group adds to it)."""
    group = group.combine_chunks()
    words = pc.split_pattern(group["suffix"].chunk(0), " ")
    flat = words.flatten().dictionary_encode()
    depth = np.diff(words.offsets.to_numpy())
    ways = np.full((len(depth), DEPTH + 1), -1, dtype=np.int32)
    ways[:, 0] = group["lang"].chunk(0).dictionary_encode().indices.to_numpy()
    ways[:, 1:][np.arange(DEPTH) < depth[:, None]] = flat.indices.to_numpy()
    order = np.lexsort(ways.T[::-1])
    ways, depth = ways[order], depth[order]
    f, prefix = group["f"].to_numpy()[order], group["prefix"].to_numpy()[order]
    changes = ways[1:] != ways[:-1]
    out = []
    for k in range(2, DEPTH + 1):
        starts = np.flatnonzero(np.concatenate(([True], changes[:, : k + 1].any(axis=1))))
        totals = np.add.reduceat(f, starts)
        whole = np.minimum.reduceat((prefix <= k).astype(np.int8), starts) == 1
        kept = depth[starts] >= k
        starts, totals, whole = starts[kept], totals[kept], whole[kept]
        spelled = [pa.DictionaryArray.from_arrays(pa.array(ways[starts, j]), flat.dictionary).cast(pa.string()) for j in range(1, k + 1)]
        phrase = pc.binary_join_element_wise(*spelled, " ")
        out.append(pa.table({"lang": group["lang"].take(pa.array(order[starts])), "phrase": phrase, "f": pa.array(totals), "whole": pa.array(whole)}))
    return pa.concat_tables(out).cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64()), ("whole", pa.bool_())]))


def trees(texts: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """lang, phrase, f of all phrases of two to ``DEPTH`` words that occur ``least`` times or more."""
    spark = texts.sparkSession
    heavy = BUDGET // 8
    frequent = bit_table(words.filter(F.col("f") >= least), "hash", WORD_BITS)
    pairs = pair_counts(texts, frequent, least)
    total = pairs.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * total // BUDGET)
    tables = [bit_table(pairs, "hash", PAIR_BITS), bit_table(words.filter(F.col("f") > heavy), "hash", HEAVY_BITS), bit_table(pairs.filter(F.col("f") > heavy), "hash", HEAVY_BITS)]
    rows = suffixes(texts, *tables, groups)
    nodes = rows.groupBy("group_id").applyInArrow(subtree, "lang string, phrase string, f long, whole boolean")
    nodes = nodes.filter((F.col("f") >= least) | ~F.col("whole"))
    return written(nodes.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "phrases")


def scored(phrases: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the lowest-scoring cut of every phrase."""
    parts = phrases.unionByName(words.filter(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), "f"))
    parts, rows = counted(parts, "parts")
    size = F.size(F.split("phrase", " "))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "cut", F.expr("substring_index(phrase, ' ', cut)").alias("head"), F.expr("substring_index(phrase, ' ', cut - size(split(phrase, ' ')))").alias("tail"))
    for side, name in (("head", "l"), ("tail", "r")):
        counts = parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(small_side(counts, rows), ["lang", side])
    score = F.expr("(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def outgrown(phrases: DataFrame) -> DataFrame:
    """lang, phrase, longest: the most occurrences of a longer candidate that a phrase lies in."""
    words = F.split("phrase", " ")
    inner = F.expr(
        "flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> array_join(slice(words, i, n), ' '))))"
    )
    longer = phrases.withColumn("words", words).filter(F.size("words") > 2)
    return longer.select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def ranked(phrases: DataFrame, words: DataFrame, least: int, top: int, share: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first ``top`` phrases."""
    rows = scored(phrases, words, least).join(outgrown(phrases), ["lang", "phrase"], "left")
    longest, a = F.col("longest").cast("decimal(19,0)"), F.col("a").cast("decimal(19,0)")
    rows = rows.filter(F.col("longest").isNull() | (longest * 100 < a * share))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's phrases are cut to the first ones in splits, so the last ranking has few rows however many there are.
    split = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SPLITS))).orderBy(*best)
    rows = rows.withColumn("place", F.row_number().over(split)).filter(F.col("place") <= top)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    sizes, langs = counted(words.groupBy("lang").agg(F.sum("f").alias("n")), "lang-sizes")
    return rows.join(small_side(sizes, langs), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80) -> DataFrame:
    """Each language's phrases that score highest: lang, rank, phrase, a, l, r, n, score.

    Phrases occur ``least`` times or more; one is out if a longer one has ``share`` per cent of its occurrences.
    """
    texts = shown(docs)
    words = word_counts(texts)
    return ranked(trees(texts, words, least), words, least, top, share)


# The same rows for the default values, for a check outside Spark.
SQL = r"""
WITH p AS MATERIALIZED (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS MATERIALIZED (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)
  GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM g WHERE k >= 2 AND f >= 30),
u AS (SELECT lang, k, phrase, f, ws, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT u.lang, u.phrase, u.f AS a, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * u.f) // (x.f + y.f) AS BIGINT) AS score
  FROM u JOIN g x ON x.lang = u.lang AND x.phrase = array_to_string(u.ws[1:u.cut], ' ')
         JOIN g y ON y.lang = u.lang AND y.phrase = array_to_string(u.ws[u.cut + 1:u.k], ' ')
  QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, u.cut) = 1),
i AS (SELECT lang, ws, f, m, unnest(range(1, k - m + 2)) AS place FROM (SELECT lang, k, ws, f, unnest(range(2, k)) AS m FROM c WHERE k > 2)),
o AS (SELECT lang, array_to_string(ws[place:place + m - 1], ' ') AS phrase, max(f) AS longest FROM i GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
z AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
      FROM s LEFT JOIN o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.longest IS NULL OR 100 * o.longest < 80 * a)
SELECT z.lang, z.rank, z.phrase, z.a, z.l, z.r, n.n, z.score FROM z JOIN n ON n.lang = z.lang WHERE z.rank <= 2000
"""
