"""Neighbouring rows and running totals along densely numbered sequences.

A plain window per route would sort a route of any length in one task. Here a route is cut into
blocks of bounded length; each block borrows the one row it needs from either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4_096


def with_neighbours(rows: DataFrame, key: str, index: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """Add ``prev_<c>`` and ``next_<c>`` of each column, null at the ends.

    ``index`` must count 0, 1, 2, ... within ``key``.
    """
    at = F.col(index)
    home = F.floor(at / block)
    places = F.array_compact(
        F.array(
            F.struct(home.alias("block"), F.lit(False).alias("borrowed")),
            F.when(at % block == block - 1, F.struct((home + 1).alias("block"), F.lit(True).alias("borrowed"))),
            F.when((at % block == 0) & (at > 0), F.struct((home - 1).alias("block"), F.lit(True).alias("borrowed"))),
        )
    )
    run = Window.partitionBy(key, "place.block").orderBy(index)
    added = {f"prev_{c}": F.lag(c).over(run) for c in columns}
    added.update({f"next_{c}": F.lead(c).over(run) for c in columns})
    return rows.withColumn("place", F.explode(places)).withColumns(added).where("not place.borrowed").drop("place")


def running_total(rows: DataFrame, key: str, index: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """Add the sum of ``value`` over all rows of ``key`` up to this one."""
    blocked = rows.withColumn("block", F.floor(F.col(index) / block))
    totals = blocked.groupBy(key, "block").agg(F.sum(value).alias("block_total"))
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "block", F.coalesce(F.sum("block_total").over(earlier), F.lit(0.0)).alias("offset"))
    within = Window.partitionBy(key, "block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.withColumn("within", F.sum(value).over(within))
        .join(offsets, [key, "block"])
        .withColumn(name, F.col("offset") + F.col("within"))
        .drop("block", "within", "offset")
    )
