"""Name resolution and similar-name suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylane.functions.text import folded, jaro_winkler
from skylane.session import counted, spread_lookup

# Lowest similarity worth suggesting; suggestions for routing and for hand-typed lists.
MIN_SIMILARITY = 0.7
ROUTE_SUGGESTIONS = 3
LIST_SUGGESTIONS = 5


def name_index(systems: DataFrame) -> DataFrame:
    """One id per exact name; of systems sharing a name the smallest id wins."""
    return systems.groupBy("name").agg(F.min("id").alias("id"))


def duplicate_names(systems: DataFrame) -> DataFrame:
    """Names borne by several systems."""
    return (
        systems.groupBy("name").agg(F.count(F.lit(1)).alias("systems"), F.min("id").alias("id")).where("systems > 1")
    )


def resolve(names: DataFrame, systems: DataFrame, column: str = "name", numeric_ids: bool = False) -> DataFrame:
    """Add ``system_id`` for the exact, case-sensitive name in ``column``; null when unknown.

    With ``numeric_ids`` a name that reads as a number is taken as the id itself.
    """
    index, rows = counted(name_index(systems).select(F.col("name").alias("asked_name"), F.col("id").alias("index_id")), "names")
    # A popular system's requests look its id up without meeting in one task.
    asked = names.withColumn("asked_name", F.col(column))
    found = spread_lookup(asked, index, "asked_name", by="request_id", rows=rows, how="left")
    system_id = F.col("index_id")
    if numeric_ids:
        system_id = F.coalesce(F.col(column).try_cast("long"), system_id)
    return found.withColumn("system_id", system_id).drop("asked_name", "index_id")


def unresolved(names: DataFrame, systems: DataFrame, column: str = "name") -> DataFrame:
    """Distinct names that no system bears exactly."""
    known = systems.select(F.col("name").alias("known"))
    return (
        names.select(F.col(column).alias("query")).where("query is not null").distinct()
        .join(known, F.col("query") == F.col("known"), "left_anti")
    )


def _required_overlap(a: Column, b: Column) -> Column:
    """Fewest shared characters with which names of lengths ``a`` and ``b`` can reach the similarity.

    A Jaro value of s needs m/a + m/b + 1 >= 3s, hence m >= (3s - 1)ab / (a + b). The prefix boost
    starts only above that value, so it cannot lift a pair over it.
    """
    return F.ceil((3 * MIN_SIMILARITY - 1) * a * b / (a + b) - 1e-9)


def _characters(name: Column) -> Column:
    """Characters of a name numbered by repetition, rarest kind first (repeats, then late letters).

    Any fixed order is right for the prefix argument below; a rare-first one makes it selective.
    """
    letters = F.split(name, "")
    numbered = F.transform(
        letters,
        lambda ch, i: F.struct(
            F.size(F.filter(F.slice(letters, 1, i + 1), lambda other: other == ch)).alias("nth"),
            ch.alias("ch"),
        ),
    )
    return F.sort_array(numbered, asc=False)


def similar_pairs(queries: DataFrame, names: DataFrame) -> DataFrame:
    """``query, name, similarity`` for every pair at or above the lowest similarity.

    Two names that need ``o`` shared characters must meet in the first ``length - o + 1`` characters
    of a common order, so pairs come from an equi join on (character, name length) over those
    prefixes; each pair is scored once, at the first character its prefixes share.
    """
    vocabulary = names.select(F.col("name")).where("length(name) > 0").distinct()
    held = vocabulary.select(
        "name", F.length("name").alias("name_length"), _characters(F.col("name")).alias("name_chars")
    ).select("*", F.posexplode("name_chars").alias("name_at", "char"))
    lengths = F.sequence(
        F.greatest(F.lit(1), F.floor(F.col("query_length") * 0.1).cast("int")),
        F.ceil(F.col("query_length") * 10.0).cast("int"),
    )
    asked = (
        queries.select("query").where("length(query) > 0").distinct()
        .select("query", F.length("query").alias("query_length"), _characters(F.col("query")).alias("query_chars"))
    )
    # Only name lengths that occur are worth a join key: at most one row per length.
    present = vocabulary.select(F.length("name").alias("name_length")).distinct()
    reach = (
        asked.select("query", "query_length", "query_chars", F.explode(lengths).alias("name_length"))
        .join(present, "name_length", "left_semi")
        .withColumn("overlap", _required_overlap(F.col("query_length"), F.col("name_length")))
        .where("overlap <= least(query_length, name_length)")
        .select("*", F.posexplode("query_chars").alias("query_at", "char"))
        .where("query_at <= query_length - overlap")
    )
    # Each name comes once per character, with all of them, so neither side is as small as its file looks.
    met = reach.hint("merge").join(held, ["char", "name_length"]).where("name_at <= name_length - overlap")
    query_prefix = F.slice("query_chars", F.lit(1), (F.col("query_length") - F.col("overlap") + 1).cast("int"))
    name_prefix = F.slice("name_chars", F.lit(1), (F.col("name_length") - F.col("overlap") + 1).cast("int"))
    shared = F.size(F.array_intersect("query_chars", "name_chars"))
    met = met.where(
        (F.get(F.array_intersect(query_prefix, name_prefix), F.lit(0)) == F.col("char")) & (shared >= F.col("overlap"))
    )
    return met.select("query", "name", jaro_winkler(F.col("query"), F.col("name")).alias("similarity")).where(
        F.col("similarity") >= MIN_SIMILARITY
    )


def suggestions(queries: DataFrame, names: DataFrame, limit: int = ROUTE_SUGGESTIONS) -> DataFrame:
    """The most similar names per query with their rank; equal similarities in name order."""
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "name")
    return (
        similar_pairs(queries, names)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= limit)
    )


def suggestion_lists(queries: DataFrame, names: DataFrame, limit: int = ROUTE_SUGGESTIONS) -> DataFrame:
    """``query, suggestions`` with the names in one array, best first."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "name")))
    return (
        suggestions(queries, names, limit)
        .groupBy("query")
        .agg(F.transform(ordered, lambda s: s["name"]).alias("suggestions"))
    )


def ship_suggestions(queries: DataFrame, ships: DataFrame, limit: int = LIST_SUGGESTIONS) -> DataFrame:
    """Ships whose name contains the query, ignoring case, first few in name order.

    Every substring of a ship name is a join key, so containment is an equi join; ship names are
    short and the catalogue is written by hand.
    """
    name = F.lower(F.col("name"))
    length = F.length("name")
    parts = F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), length),
                lambda i: F.transform(F.sequence(F.lit(1), length - i + 1), lambda n: F.substring(name, i, n)),
            )
        )
    )
    held = ships.select("name", F.explode(parts).alias("part"))
    asked = queries.select("query").distinct().withColumn("part", F.lower("query"))
    first = Window.partitionBy("query").orderBy("name")
    return (
        asked.join(held, "part")
        .select("query", "name")
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= limit)
    )


__all__ = [
    "duplicate_names",
    "folded",
    "name_index",
    "resolve",
    "ship_suggestions",
    "similar_pairs",
    "suggestion_lists",
    "suggestions",
    "unresolved",
]
