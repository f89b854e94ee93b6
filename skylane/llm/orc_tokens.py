"""Token ids as ORC files in ascending id order, and the per-document facts read back from them.

ORC keeps a list column as integer run-length encoded streams inside stripes; each stripe has row
indexes (minimum, maximum and positions for every ``ROWS_PER_INDEX`` rows) and, for ``doc_id``, Bloom
filters. A reader takes stripes in parallel, and one that asks for some ids skips stripes and row
groups by the statistics and the filters alone. Spark's own ORC source does both, so this module
only lays the table out: documents are dealt by ranges of the id, sorted, encoded and written, each
range one file, in one stage after the shuffle, which a lost executor repeats by itself.

Columns of the files: ``part`` (number of the range, ascending with the ids), ``row`` (place inside
it), ``doc_id``, ``ids`` (list of int, the end id included).

Defined results: a null text counts as empty and is the end id alone; rows with a null id come first;
rows with equal ids are all kept, in the order of their texts; an empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylane.llm import word_pieces
from skylane.session import work_area, written

STRIPE_BYTES = 64 << 20
ROWS_PER_INDEX = 1_000
OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(STRIPE_BYTES),
    "orc.row.index.stride": str(ROWS_PER_INDEX),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
# Rows that are turned into one Arrow batch of lists, so that a batch of very long documents stays small.
_BATCH_IDS = 4_000_000


def encode(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """doc_id, ids of every whole text, in the order of the rows given."""
    end = np.array([] if end_id is None else [end_id], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def batch(keys: list, rows: list, found: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([0] + [len(x) // 4 for x in found]).astype("int32")
        values = pa.array(np.frombuffer(b"".join(found), dtype="<i4"), type=pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(ends), values)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.int64()), lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = word_pieces.load(tokenizer)
        place, held = 0, 0
        keys, rows, found = [], [], []
        for ids, texts in word_pieces.id_and_text(batches):
            for key, text in zip(ids, texts):
                encoded = pieces.ids(text) + end
                keys.append(key)
                rows.append(place)
                found.append(encoded)
                place += 1
                held += len(encoded) // 4
                if held >= _BATCH_IDS:
                    yield batch(keys, rows, found)
                    keys, rows, found, held = [], [], [], 0
        yield batch(keys, rows, found)

    return docs.mapInArrow(run, "doc_id long, row long, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, files: int) -> None:
    """Write the token ids of ``docs`` to ``path`` as about ``files`` ORC files in ascending id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    table = encode(ordered, tokenizer, end_id).select(F.spark_partition_id().alias("part"), "row", "doc_id", "ids")
    table.write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str, condition: Column | None = None) -> DataFrame:
    """The stored table; a condition on ``doc_id`` or ``part`` prunes stripes and row groups."""
    table = spark.read.schema("part int, row long, doc_id long, ids array<int>").orc(path)
    return table if condition is None else table.filter(condition)


def facts(table: DataFrame) -> DataFrame:
    """Per document of a stored table: doc_id, start, n_tokens, ids_crc32.

    ``start`` is a running total in two levels: sums per range, of which there are as many as files,
    and inside a range by place.
    """
    schema = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(memoryview(flat[a:b])) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype("int64")), pa.array(sums, pa.int64())],
                schema=schema,
            )

    per_doc = table.mapInArrow(run, "part int, row long, doc_id long, n_tokens long, ids_crc32 long")
    per_doc = written(per_doc, "token-facts")
    parts = per_doc.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = F.sum("held").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n_tokens").over(W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    placed = per_doc.withColumn("inside", F.coalesce(inside, F.lit(0)))
    # One row per file, as Spark's own listing of the files on the driver has.
    return placed.join(F.broadcast(parts), "part").select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def new_path(spark: SparkSession) -> str:
    return f"{work_area(spark)}/tokens-{uuid.uuid4().hex}.orc"
