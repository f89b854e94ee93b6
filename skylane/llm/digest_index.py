"""Exact duplicates by a persistent index of text digests, bucketed and sorted by digest.

A batch of documents is reduced to one row per digest, anti-joined with the index by a sort-merge
join that reads the index without shuffling it, and what is new is appended. The texts themselves
are read once and never shuffled.

Defined results: a null text counts as empty, and empty texts equal each other; of equal texts the
longest original stays, then a row with an id, then the smallest id; a text that an earlier batch has
brought stays with that batch's document. Where the row that stays lacks an id, ``keep_id`` is null. In the
answers a row repeated with the same id and an equal text is kept like its twin; ``without_copies`` keeps
exactly one row of each text, whichever of such twins. An empty batch gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylane.llm.common import WHITE_CLASS, counted, join_answers, text_of
from skylane.session import work_area, written

BUCKETS = 64


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text without white space, in UTF-8."""
    return F.sha2(F.regexp_replace(text, WHITE_CLASS + "+", "").cast("binary"), 256)


class DigestIndex:
    """A table of digests seen so far at ``path``: digest, keep_id; bucketed and sorted by digest.

    The same path opened again, in this session or a later one, continues the same index. Appending
    adds files; a failed append leaves rows of a batch only as a whole, as Spark commits them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark = spark
        self.buckets = buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, winners: DataFrame) -> None:
        """Append the rows of ``winners`` (digest, keep_id; one per digest) whose digest is new."""
        fresh = winners.select("digest", "keep_id").join(self.table().hint("merge"), "digest", "left_anti")
        # Written before the append, so that the append never reads the table that it changes.
        fresh = written(fresh, "fresh-digests")
        fresh.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def deduplicate(self, docs: DataFrame) -> DataFrame:
        """Add a batch; returns doc_id, keep_id, group_size, kept, text_sha256 for each of its rows.

        ``group_size`` counts the rows of this batch that share the text.
        """
        text = text_of()
        rows, total = counted(
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), F.char_length(text).alias("chars")),
            "digests",
        )
        # The largest (chars, has an id, smallest id): bitwise_not turns the order of ids round without overflow.
        best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("turned")))
        groups = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        winners = written(groups.select("digest", F.bitwise_not("best.turned").alias("keep_id"), "group_size"), "winners")
        self.add(winners)
        answers = written(winners.select("digest", "group_size").join(self.table().hint("merge"), "digest"), "answers")
        return join_answers(rows, answers, "digest", "group_size", total).select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )


def fresh_index(spark: SparkSession, buckets: int = BUCKETS) -> DigestIndex:
    """An empty index in a new folder of the work area."""
    return DigestIndex(spark, f"{work_area(spark)}/digest-index-{uuid.uuid4().hex}", buckets)


def without_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row of each text that is new to the index, the one that it keeps, with all its columns."""
    found = index.deduplicate(docs)
    pair = [F.col("doc_id").alias("_of_id"), F.col("text_sha256").alias("_of_digest")]
    columns = docs.columns
    dropped = found.filter(~F.col("kept")).select(*pair).distinct()
    own = digest(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.withColumn("_digest", own)

    def same(pairs: DataFrame) -> Column:
        return rows["doc_id"].eqNullSafe(pairs["_of_id"]) & (rows["_digest"] == pairs["_of_digest"])

    # Rows repeated with one id and an equal text are all as good as the one that stays; only these meet once more.
    twins = written(found.filter("kept").groupBy(*pair).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1").drop("_times"), "twins")
    if twins.isEmpty():
        return rows.join(dropped, same(dropped), "left_anti").select(*columns)
    one = rows.join(twins, same(twins), "left_semi").dropDuplicates(["doc_id", "_digest"])
    out = dropped.unionByName(twins)
    return rows.join(out, same(out), "left_anti").unionByName(one).select(*columns)


# The same rows, for a check outside Spark.
SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
