"""Gate, spatial and hybrid edge tables.

An edge row is ``src, dst, kind ('gate' | 'spatial'), distance`` with the destination's attributes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylane.functions.geometry import distance
from skylane.operators.spatial import nearest, radius_join
from skylane.session import shuffled_side, spread_lookup, written, written_counting

# Gate length when a position is missing.
UNPLACED_GATE_LENGTH = 1.0


def known_jumps(jumps: DataFrame, systems: DataFrame) -> DataFrame:
    """Jumps whose two ends are both known systems."""
    rows = systems.count()
    ids = shuffled_side(systems.select(F.col("id").alias("one")), rows)
    others = shuffled_side(systems.select(F.col("id").alias("other")), rows)
    return jumps.join(ids, F.col("src") == F.col("one"), "left_semi").join(others, F.col("dst") == F.col("other"), "left_semi")


def dangling_jumps(jumps: DataFrame, systems: DataFrame) -> DataFrame:
    """Jumps with an unknown end: one row per jump row and distinct unknown end."""
    known = systems.select(F.col("id").alias("known_src"))
    marked = jumps.join(known, jumps["src"] == known["known_src"], "left").select(
        "src", "dst", F.col("known_src").isNotNull().alias("src_known")
    )
    ends = marked.select("*", F.explode(F.array_distinct(F.array("src", "dst"))).alias("unknown_id"))
    return ends.join(systems.select("id"), F.col("unknown_id") == F.col("id"), "left_anti")


def dangling_report(jumps: DataFrame, systems: DataFrame) -> DataFrame:
    """Rows ``item, id, jumps``: the number of skipped jump rows, and of those at each unknown id."""
    bad = dangling_jumps(jumps, systems)
    skipped = bad.agg(
        # A jump with two bad ends gives two rows here; count it at its first bad end only.
        F.count_if((F.col("unknown_id") == F.col("src")) | F.col("src_known")).alias("jumps")
    )
    each = bad.groupBy(F.col("unknown_id").alias("id")).agg(F.count(F.lit(1)).alias("jumps"))
    return skipped.select(F.lit("skipped").alias("item"), F.lit(None).cast("long").alias("id"), "jumps").unionByName(
        each.select(F.lit("unknown_id").alias("item"), "id", "jumps")
    )


def gate_pairs(jumps: DataFrame, systems: DataFrame) -> DataFrame:
    """Two-way gate connections without duplicates; self loops stay."""
    valid = known_jumps(jumps, systems)
    return valid.unionByName(valid.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def _ends(pairs: DataFrame, systems: DataFrame) -> DataFrame:
    a = systems.select(F.col("id").alias("src"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = systems.select(
        F.col("id").alias("dst"),
        *[F.col(c).alias(f"b{c}") for c in "xyz"],
    )
    rows = systems.count()
    return pairs.join(shuffled_side(a, rows), "src").join(shuffled_side(b, rows), "dst")


def gate_edges(pairs: DataFrame, systems: DataFrame) -> DataFrame:
    """Gate edges with their length in light-years; 1.0 when an end has no position."""
    length = distance(*[F.col(f"a{c}") for c in "xyz"], *[F.col(f"b{c}") for c in "xyz"])
    return _ends(pairs, systems).select(
        "src",
        "dst",
        F.lit("gate").alias("kind"),
        F.coalesce(length, F.lit(UNPLACED_GATE_LENGTH)).alias("distance"),
    )


@dataclass(frozen=True)
class NeighbourGraph:
    """Which jumps one class of requests may use.

    ``max_jump`` limits the length (inclusive), ``max_temperature`` the target's ambient temperature
    (an unknown one passes) before anything is ranked, and ``neighbours`` the targets kept per
    source, also within a radius. Null or 0 neighbours means no limit, which needs a radius.
    """

    graph_id: int = 1
    max_jump: float | None = None
    max_temperature: float | None = None
    neighbours: int | None = None

    def __post_init__(self) -> None:
        if not self.neighbours and self.max_jump is None:
            raise ValueError("a jump graph needs a radius or a neighbour count")


GRAPH = "graph_id long, k int, radius double, limit double"


def graph_table(spark: SparkSession, graphs: list[NeighbourGraph]) -> DataFrame:
    return spark.createDataFrame([(g.graph_id, g.neighbours or None, g.max_jump, g.max_temperature) for g in graphs], GRAPH)


def neighbour_edges(systems: DataFrame, graphs: DataFrame) -> DataFrame:
    """Jump edges of a table of graphs in one pass: ``graph_id, src, dst, kind, distance, rank``.

    ``graphs`` are ``graph_id, k, radius, limit`` with the meaning of ``NeighbourGraph``. ``rank`` is the
    target's place among its source's neighbours, null in graphs without a limit. Positions stay double
    throughout.
    """
    graphs, count = written_counting(graphs, "graphs", F.lit(True))
    shape = graphs.agg(
        F.max("k").alias("most"),
        F.bool_and(F.col("limit").isNull() | F.col("k").isNull()).alias("cold"),
        F.max(F.when(F.col("k").isNull(), F.col("radius"))).alias("widest"),
    ).first()
    placed = written(systems.where(F.col("x").isNotNull()).select("id", "x", "y", "z", "min_external_temp"), "placed")
    targets = placed
    fits = (F.col("query_id.src") != F.col("id")) & F.coalesce(
        F.col("min_external_temp") <= F.col("limit"), F.lit(True)
    )
    parts = []
    if shape["most"]:
        queries = _graph_queries(placed, graphs.where("k is not null"), count)
        if not shape["cold"]:
            queries = queries.withColumns({"heat_limit": F.col("limit"), "shuns": F.lit(0), "slack": F.lit(1)})
            targets = targets.withColumns({"heat": F.col("min_external_temp"), "tags": F.lit(0)})
        parts.append(nearest(queries, targets, keep=fits, per_place=shape["most"] + 1 if shape["cold"] else None))
    if shape["widest"] is not None:
        queries = _graph_queries(placed, graphs.where("k is null"), count)
        # Limits and temperatures go to either side by its id before the pairs, which are far more, are formed.
        limited = queries.select("query_id", "x", "y", "z").join(queries.select("query_id", "radius", "limit"), "query_id")
        warm = targets.select("id", "x", "y", "z").join(targets.select("id", "min_external_temp"), "id")
        close = radius_join(limited, warm, shape["widest"], keep=fits & (F.col("distance") <= F.col("radius")))
        parts.append(close.select("query_id", "id", "distance", F.lit(None).cast("int").alias("rank")))
    return reduce(DataFrame.unionByName, parts).select(
        F.col("query_id.graph_id").alias("graph_id"),
        F.col("query_id.src").alias("src"),
        F.col("id").alias("dst"),
        F.lit("spatial").alias("kind"),
        "distance",
        "rank",
    )


def _graph_queries(placed: DataFrame, graphs: DataFrame, count: int) -> DataFrame:
    """Every positioned system once per graph, with that graph's limits."""
    every = spread_lookup(
        placed.select("id", "x", "y", "z", F.lit(1).alias("every")), graphs.withColumn("every", F.lit(1)), "every", "id", count
    )
    return every.select(
        F.struct("graph_id", F.col("id").alias("src")).alias("query_id"), "x", "y", "z", "k", "radius", "limit"
    )


def spatial_edges(
    systems: DataFrame,
    *,
    max_jump: float | None = None,
    max_temperature: float | None = None,
    neighbours: int | None = None,
) -> DataFrame:
    """Jump edges of a single graph; see ``NeighbourGraph`` for the limits."""
    graph = NeighbourGraph(1, max_jump, max_temperature, neighbours)
    return neighbour_edges(systems, graph_table(systems.sparkSession, [graph])).drop("graph_id")


def merge_edges(gates: DataFrame, spatial: DataFrame) -> DataFrame:
    """Hybrid edges: both kinds to one target are kept, duplicates of a kind keep the shortest."""
    both = gates.select("src", "dst", "kind", "distance").unionByName(
        spatial.select("src", "dst", "kind", "distance")
    )
    return both.groupBy("src", "dst", "kind").agg(F.min("distance").alias("distance"))


def edges_in_order(edges: DataFrame) -> DataFrame:
    """Edges of each source by length, a gate before a jump of equal length.

    One range-partitioned sort; since length is part of the key, even a hub's edges spread over tasks.
    """
    return edges.orderBy("src", "distance", "kind", "dst")


def adjacency(pairs: DataFrame, systems: DataFrame | None = None) -> DataFrame:
    """Distinct ``src, dst`` in order, one row per target, so a hub's targets spread over tasks.

    With ``systems`` a system without an edge has one row with a null ``dst``.
    """
    rows = pairs.select("src", "dst").distinct()
    if systems is not None:
        rows = systems.select(F.col("id").alias("src")).distinct().join(rows, "src", "left")
    return rows.orderBy("src", F.col("dst").asc_nulls_first())
