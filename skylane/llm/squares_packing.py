"""Packing documents into fixed-length sequences by the sum-of-squares rule.

Texts are encoded where they are read; only the measures of their pieces (id, place, length, checksum)
are shuffled. Pieces are dealt at random to lanes of about ``LANE_PIECES`` and every lane is packed by
itself, so the number of lanes grows with the input and no task with it. Inside a lane the pieces come
by falling length; each goes where the sum over all residual gaps of (open bins with that gap) squared
becomes smallest, a new bin included among the choices. A full bin has no gap and leaves the sum.

Defined results: a null text counts as empty and has the end id alone; a document longer than the
sequence is cut into full pieces and a last one that may be shorter, no other is cut; pieces of equal
length are interchangeable; rows with a null or repeated id are packed like any other; an empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylane.llm import word_pieces
from skylane.llm.common import counted

LANE_PIECES = 20_000
_PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int) -> DataFrame:
    """The measures of every document's pieces; ``row`` counts inside an input split."""
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    )
    width = 4 * limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_pieces.load(tokenizer)
        row = 0
        for keys, texts in word_pieces.id_and_text(batches):
            out: list[tuple] = []
            for key, text in zip(keys, texts):
                ids = encoder.ids(text) + end
                for n, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    out.append((key, row, n, at // 4, len(part) // 4, zlib.crc32(part)))
                row += 1
            yield word_pieces.arrow_batch(schema, list(zip(*out)) or [[]] * 6)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECES)


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the order given.

    Moving one bin from gap g to gap g - s changes the sum of squares by 2 (N(g - s) - N(g) + 1); a new
    bin by 2 N(limit - s) + 1; filling a bin by 1 - 2 N(g). Of equal changes the smallest gap wins.
    """
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(limit + 1)]
    count = np.zeros(limit + 1, dtype=np.int64)  # by gap; a full bin and a new one are not counted
    made = 0
    for i, s in enumerate(lengths.tolist()):
        change = 2 * (count[: limit - s] - count[s:limit] + 1)
        if s < limit:
            change[0] = 1 - 2 * count[s]
        change[count[s:limit] == 0] = np.iinfo(np.int64).max
        fresh = 2 * count[limit - s] + 1 if s < limit else 0
        at = int(change.argmin()) if len(change) else -1
        if at >= 0 and change[at] <= fresh:
            gap = s + at
            chosen = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, chosen = limit, made
            made += 1
        bins[i] = chosen
        offsets[i] = limit - gap
        if gap > s:
            open_bins[gap - s].append(chosen)
            count[gap - s] += 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, end_id: int, limit: int) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    measured, total = counted(pieces(docs, tokenizer, end_id, limit), "pieces")
    lanes = max(1, math.ceil(total / LANE_PIECES))
    place = F.pmod(F.xxhash64("doc_id", "row", "piece", "length", "ids_crc32"), F.lit(lanes))

    def run(key: tuple, lane: pd.DataFrame) -> pd.DataFrame:
        lane = lane.sort_values(["length", "doc_id", "piece", "row", "ids_crc32"], ascending=[False, True, True, True, True])
        bins, offsets = sum_of_squares(lane["length"].to_numpy(), limit)
        lane["sequence_id"] = (int(key[0]) << 32) + bins
        lane["offset"] = offsets
        return lane[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    return measured.withColumn("lane", place).groupBy("lane").applyInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
