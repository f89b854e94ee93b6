"""Bounded tables of bits over hashes, built by the executors and sent to tasks: a filter that only ever keeps too much."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bit_table(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """2**bits bits, one set for each hash in ``column`` (a long) by its lowest ``bits`` bits.

    Its size does not depend on the rows: at most 2**(bits - 6) sums of 64 bits come to the driver. With very many
    hashes it fills up and holds back less; it never holds back a hash that is among the rows.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = rows.select(F.shiftright(slot, 6).cast("int").alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("at"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("held")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.int64)
    table[found["word"].to_numpy()] = found["held"].to_numpy()
    return table.view(np.uint64)


def holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (unsigned, 64 bits) may be among those that the table was made of."""
    slot = hashes & np.uint64(len(table) * 64 - 1)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
