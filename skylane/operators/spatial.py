"""Radius and nearest-neighbour joins over positions, without comparing all pairs.

Both joins key points by cubic grid cells and meet in an equi join on the cell, so Spark shuffles and
splits the work. Cells that hold many targets are salted over several join keys.

Queries are ``query_id, x, y, z`` (plus ``k`` and ``radius`` for ``nearest``) and targets
``id, x, y, z``; further columns of either side may be used in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylane.functions.geometry import cell, distance, room_in_block
from skylane.session import BROADCAST_ROWS, counted, shuffled_side, written

# Targets of one cell that share a join key; a cell with more is salted.
CELL_SHARE = 4_096
# Finer grids tried below the one that suits evenly spread targets.
FINER_GRIDS = 8
# Bands of heat that targets are counted by, and how many different tags there can be.
HEAT_BANDS = 16
TAG_BITS = 4

_CELL = ["cx", "cy", "cz"]


def _query_columns(queries: DataFrame) -> DataFrame:
    return queries.withColumnsRenamed({"x": "qx", "y": "qy", "z": "qz"})


def _cells_of(df: DataFrame, size: float, x: str, y: str, z: str) -> DataFrame:
    return df.withColumns({c: cell(F.col(v), size) for c, v in zip(_CELL, (x, y, z))})


# Cells around a query, its own included.
_BLOCK = 27


def _around(queries: DataFrame, asked: int, size: float) -> DataFrame:
    """Each query once per cell of the 3x3x3 around it."""
    if asked * _BLOCK > BROADCAST_ROWS:
        # Many queries may lie in one small file, and where targets are broadcast nothing else would deal them out.
        queries = queries.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = _cells_of(queries, size, "qx", "qy", "qz")
    for c in _CELL:
        near = near.withColumn("step", F.explode(around)).withColumn(c, F.col(c) + F.col("step")).drop("step")
    return near


def _cell_join(near: DataFrame, asked: int, held: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """Meet on the cell; a side is broadcast only if its counted rows (``asked`` queries) are few.

    Left to itself Spark would judge the side ``near`` by the files of the queries, before each was laid out on 27 cells.
    """
    if rows <= BROADCAST_ROWS:
        return near.join(F.broadcast(held), keys)
    if asked * _BLOCK <= BROADCAST_ROWS:
        return held.join(F.broadcast(near), keys)
    return near.hint("merge").join(held, keys)


def _block_join(queries: DataFrame, asked: int, targets: DataFrame, rows: int, size: float, salted: bool) -> DataFrame:
    """Each query with every target in the 3x3x3 cells around it."""
    near = _around(queries, asked, size)
    held = _cells_of(targets, size, "x", "y", "z")
    keys = list(_CELL)
    if salted:
        crowded = (
            held.groupBy(*_CELL)
            .agg(F.count(F.lit(1)).alias("held"))
            .where(F.col("held") > CELL_SHARE)
            .select(*_CELL, F.ceil(F.col("held") / CELL_SHARE).cast("int").alias("fan"))
        )
        # At most one cell in CELL_SHARE targets.
        crowded = F.broadcast(crowded) if rows <= CELL_SHARE * BROADCAST_ROWS else crowded
        fan = F.coalesce(F.col("fan"), F.lit(1))
        held = held.join(crowded, _CELL, "left").withColumn("salt", F.pmod(F.xxhash64("id"), fan).cast("int")).drop("fan")
        near = (
            near.join(crowded, _CELL, "left")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), fan - 1)))
            .drop("fan")
        )
        keys.append("salt")
    return _cell_join(near, asked, held, rows, keys).drop(*keys)


def _separation() -> Column:
    return distance(F.col("qx"), F.col("qy"), F.col("qz"), F.col("x"), F.col("y"), F.col("z"))


def radius_join(queries: DataFrame, targets: DataFrame, radius: float, keep: Column | None = None) -> DataFrame:
    """All ``(query_id, id, distance)`` at most ``radius`` apart (inclusive); none for radius <= 0.

    ``keep`` filters the pairs where they meet, ``distance`` included, so no pair travels for it.
    """
    if radius <= 0:
        return queries.join(targets, F.lit(False)).select("query_id", "id", F.lit(0.0).alias("distance"))
    queries, asked = counted(_query_columns(queries), "radius-queries")
    targets, rows = counted(targets, "radius-targets")
    pairs = _block_join(queries, asked, targets, rows, float(radius), salted=True)
    close = pairs.withColumn("distance", _separation()).where(F.col("distance") <= F.lit(float(radius)))
    if keep is not None:
        close = close.where(keep)
    return close.select("query_id", "id", "distance")


def _thin_places(targets: DataFrame, per_place: int) -> DataFrame:
    """At most ``per_place`` targets, by smallest id, of those at one identical position."""
    place = Window.partitionBy("x", "y", "z").orderBy("id")
    return targets.withColumn("n", F.row_number().over(place)).where(F.col("n") <= per_place).drop("n")


def _measure(queries: DataFrame, targets: DataFrame):
    """Extent of all points, number of targets."""
    points = targets.select("x", "y", "z", F.lit(1).alias("t")).unionByName(
        queries.select("x", "y", "z", F.lit(0).alias("t"))
    )
    bounds = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    row = points.agg(F.sum("t").alias("targets"), *bounds).first()
    if not row["targets"]:
        return 0.0, 0
    return max(row[f"hi_{c}"] - row[f"lo_{c}"] for c in "xyz"), row["targets"]


def _starting_size(targets: DataFrame, extent: float, count: int, fill: int) -> tuple[float, int]:
    """Largest tried cell size whose fullest cell holds at most ``fill`` targets, and that fullness."""
    even = extent * min(1.0, (fill / count)) ** (1.0 / 3.0)
    sizes = [even / 2**i for i in range(FINER_GRIDS)]
    tried = targets.select(
        F.posexplode(F.array(*[F.lit(s) for s in sizes])).alias("level", "size"), "x", "y", "z"
    )
    fullest = (
        tried.groupBy("level", *[F.floor(F.col(c) / F.col("size")).alias(f"c{c}") for c in "xyz"])
        .agg(F.count(F.lit(1)).alias("held"))
        .groupBy("level")
        .agg(F.max("held").alias("held"))
        .collect()
    )
    held = {r["level"]: r["held"] for r in fullest}
    level = next((i for i in range(FINER_GRIDS) if held[i] <= fill), FINER_GRIDS - 1)
    return sizes[level], held[level]


def nearest(
    queries: DataFrame,
    targets: DataFrame,
    *,
    keep: Column | None = None,
    per_place: int | None = None,
) -> DataFrame:
    """The ``k`` nearest targets of every query as ``query_id, id, distance, rank``.

    ``queries`` carry ``k`` and a nullable inclusive ``radius``; ``keep`` filters
    pairs before ranking. Ties go to the smaller id. A query with fewer than ``k`` matches gets all
    it has.

    Each round joins the unfinished queries with the targets in the 27 cells around them. A query is
    finished once its k-th match is no farther than the nearest side of that block, so nothing outside
    can be closer; or its radius ends inside the block; or the block spans the whole map. The rest go
    on with cells of twice the size. The first size is set by the fullest cell, so that dense areas
    finish on fine grids and never meet as a whole.

    What ``keep`` asks of a target alone may be said in columns as well: targets carry ``heat`` (nullable) and ``tags``
    (bits below ``2 ** TAG_BITS``), queries ``heat_limit`` (nullable), ``shuns`` (tags that rule a target out) and
    ``slack`` (how many more targets ``keep`` may rule out). Then a tree of counts goes ahead of the pairs: targets
    counted by cell, tags and band of heat, at each round's size. A query meets targets only in a block that counts
    enough for it, and one for which the whole map has too few is answered from the coldest targets of each tag, which
    are the only ones it can take. So no query meets the map because it asks for more than there is.

    ``per_place`` may be given when ``keep`` drops fewer than ``per_place`` less the largest ``k`` targets of any
    query: of many targets at one identical position only that many can matter.
    """
    spark = queries.sparkSession
    if per_place is not None:
        targets = _thin_places(targets, per_place)
    queries, asked = counted(queries.where("x is not null and y is not null and z is not null and k > 0"), "knn-queries")
    targets = written(targets.where("x is not null and y is not null and z is not null"), "knn-targets")
    schema = "query_id {}, id {}, distance double, rank int".format(
        queries.schema["query_id"].dataType.simpleString(), targets.schema["id"].dataType.simpleString()
    )
    max_k = queries.agg(F.max("k")).first()[0]
    extent, count = _measure(queries, targets) if max_k else (0.0, 0)
    if count == 0:
        return spark.createDataFrame([], schema)
    if extent == 0.0:
        size, held = 1.0, count
    else:
        size, held = _starting_size(targets, extent, count, fill=2 * (max_k + 1))
    pending = _query_columns(queries)
    finished: DataFrame | None = None
    bands = None
    if {"heat", "tags"} <= set(targets.columns) and {"heat_limit", "shuns", "slack"} <= set(queries.columns):
        bands = _heat_bands(targets)
        finished, pending, asked = _answered_by_coldest(pending, targets, keep)
        if not asked:
            return finished
    while True:
        whole_map = size >= extent
        able = pending
        if bands is not None and not whole_map:
            able = written(_with_enough(pending, asked, targets, count, size, bands), "knn-able")
        ranked = written(
            _ranked_block(able, asked, targets, count, size, whole_map, keep, max_k, salted=held > CELL_SHARE),
            "knn-round",
        )
        done = ranked.where("done").select("query_id", "id", "distance", "rank")
        finished = done if finished is None else finished.unionByName(done)
        if whole_map:
            return finished
        inside = F.coalesce(F.col("radius") <= _room(size), F.lit(False))
        left = pending.where(~inside).join(shuffled_side(done.where("rank = 1"), asked), "query_id", "left_anti")
        pending, asked = counted(left, "knn-pending")
        if not asked:
            return finished
        size, held = size * 2, min(held * 8, count)


def _cut_to_radius(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("distance", _separation()).where(
        F.col("radius").isNull() | ((F.col("radius") > 0) & (F.col("distance") <= F.col("radius")))
    )


def _heat_bands(targets: DataFrame) -> list[float]:
    """Upper ends of the bands of heat, so that each holds about as many targets."""
    cuts = targets.agg(F.percentile_approx("heat", [i / HEAT_BANDS for i in range(1, HEAT_BANDS + 1)]).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


def _band(heat: Column, cuts: list[float]) -> Column:
    """0 without heat, else 1 and the number of cuts below it."""
    ends = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    return F.when(heat.isNull(), 0).otherwise(F.size(F.filter(ends, lambda c: c < heat)) + 1)


def _need() -> Column:
    return F.col("k") + F.col("slack")


def _answered_by_coldest(pending: DataFrame, targets: DataFrame, keep: Column | None) -> tuple[DataFrame, DataFrame, int]:
    """Answers of the queries for which the map has too few targets, the other queries, and how many these are.

    Of every tag the coldest targets are listed, one more than any query needs. A query that finds fewer than it
    needs among them finds all it can take there.
    """
    most = pending.agg(F.max(_need())).first()[0]
    coldest = Window.partitionBy("tags").orderBy(F.col("heat").asc_nulls_first(), "id")
    listed = targets.withColumn("n", F.row_number().over(coldest)).where(F.col("n") <= most + 1)
    listed = written(listed.drop("n"), "knn-coldest")
    fits = (F.col("tags").bitwiseAND(F.col("shuns")) == 0) & (F.col("heat_limit").isNull() | F.col("heat").isNull() | (F.col("heat") <= F.col("heat_limit")))
    asked = pending.groupBy("heat_limit", "shuns").agg(F.max(_need()).alias("most"))
    # The list holds at most 2 ** TAG_BITS times the largest number asked for, and is not more than that for any map.
    found = asked.join(F.broadcast(listed.select("heat", "tags")), fits, "left").groupBy("heat_limit", "shuns").agg(F.count("tags").alias("there"))
    found = written(found, "knn-there")
    kinds = found.select(F.col("heat_limit").alias("its_limit"), F.col("shuns").alias("its_shuns"), "there")
    same = F.col("heat_limit").eqNullSafe(F.col("its_limit")) & (F.col("shuns") == F.col("its_shuns"))
    matched = written(pending.join(kinds, same, "left").drop("its_limit", "its_shuns"), "knn-counted")
    few = matched.where(F.col("there") < _need()).drop("there")
    pairs = few.join(F.broadcast(listed), fits)
    if keep is not None:
        pairs = pairs.where(keep)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    answers = _cut_to_radius(pairs).withColumn("rank", rank).where(F.col("rank") <= F.col("k")).select("query_id", "id", "distance", "rank")
    return written(answers, "knn-few"), *counted(matched.where(~(F.col("there") < _need())).drop("there"), "knn-many")


def _with_enough(pending: DataFrame, asked: int, targets: DataFrame, rows: int, size: float, cuts: list[float]) -> DataFrame:
    """Queries whose block counts as many targets as they need, or holds their whole radius."""
    cells = _cells_of(targets, size, "x", "y", "z").groupBy(*_CELL, "tags", _band(F.col("heat"), cuts).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    top = F.when(F.col("heat_limit").isNull(), F.lit(len(cuts) + 1)).otherwise(_band(F.col("heat_limit"), cuts))
    near = _around(pending.select("query_id", "qx", "qy", "qz", "shuns", top.alias("top")), asked, size)
    met = _cell_join(near, asked, cells, rows, _CELL).where((F.col("tags").bitwiseAND(F.col("shuns")) == 0) & (F.col("band") <= F.col("top")))
    there = met.groupBy("query_id").agg(F.sum("n").alias("there"))
    inside = F.coalesce(F.col("radius") <= _room(size), F.lit(False))
    return pending.join(there, "query_id", "left").where(inside | (F.coalesce("there", F.lit(0)) >= _need())).drop("there")


def _room(size: float) -> Column:
    return F.least(*[room_in_block(F.col(c), size) for c in ("qx", "qy", "qz")])


def _ranked_block(
    pending: DataFrame, asked: int, targets: DataFrame, rows: int, size: float, whole_map: bool, keep: Column | None, max_k: int, salted: bool
) -> DataFrame:
    pairs = _block_join(pending.withColumn("room", _room(size)), asked, targets, rows, size, salted)
    if keep is not None:
        pairs = pairs.where(keep)
    pairs = _cut_to_radius(pairs)
    by_query = Window.partitionBy("query_id")
    ranked = (
        pairs.withColumn("rank", F.row_number().over(by_query.orderBy("distance", "id")))
        # The literal bound lets Spark cut each group before the shuffle; k then cuts per query.
        .where((F.col("rank") <= max_k) & (F.col("rank") <= F.col("k")))
        .withColumn("sure", F.count_if(F.col("distance") <= F.col("room")).over(by_query))
    )
    done = (
        F.lit(True)
        if whole_map
        else (F.col("sure") >= F.col("k")) | F.coalesce(F.col("radius") <= F.col("room"), F.lit(False))
    )
    return ranked.select("query_id", "id", "distance", "rank", done.alias("done"))
