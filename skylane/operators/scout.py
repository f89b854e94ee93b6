"""Scouting: gate neighbours, filtered nearest systems, system details, visiting tours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.functions.geometry import METRES_PER_LIGHT_YEAR, METRES_PER_LIGHT_YEAR_FIXTURE, distance
from skylane.functions.ship_physics import HEAT_NOMINAL
from skylane.functions.text import is_developer_system
from skylane.operators.enrich import fold_fuel, hop_heat
from skylane.operators.names import resolve
from skylane.operators.ordered import with_neighbours
from skylane.operators.requests import checked, effective_scout_temperature, scout_problem, scout_requests
from skylane.operators.spatial import nearest, radius_join
from skylane.session import counted, shuffled_side, spread_lookup, written

DETAILS = ["name", "min_external_temp", "planet_count", "moon_count"]


# Tags of systems that a request may shun: hidden ones, and those with a gate.
_HIDDEN, _GATED = 1, 2


def scout_gates(requests: DataFrame, pairs: DataFrame, systems: DataFrame) -> DataFrame:
    """Gate neighbours of each request's system, developer systems hidden unless asked for.

    ``requests`` are ``request_id, system_id, include_dev``.
    """
    details = systems.select(F.col("id").alias("neighbour_id"), *DETAILS)
    neighbours = pairs.select(F.col("src").alias("system_id"), F.col("dst").alias("neighbour_id"))
    return (
        requests.join(neighbours, "system_id")
        .join(details, "neighbour_id")
        .where(F.col("include_dev") | ~is_developer_system(F.col("name")))
        .select("request_id", "system_id", "neighbour_id", *DETAILS)
    )


def by_name(rows: DataFrame) -> DataFrame:
    return rows.orderBy("request_id", "name", "neighbour_id")


def resolved_scouts(requests: DataFrame, systems: DataFrame, radius_required: bool = False) -> DataFrame:
    """Scout requests with problem, system id, position and effective temperature cap."""
    asked = checked(scout_requests(requests), scout_problem(radius_required))
    asked = resolve(asked, systems, "system", numeric_ids=True).withColumn(
        "max_temperature", effective_scout_temperature()
    )
    places = systems.select(F.col("id").alias("system_id"), "x", "y", "z", F.col("min_external_temp").alias("origin_temp"))
    located = asked.join(shuffled_side(places, systems.count()), "system_id", "left")
    return located.withColumn(
        "problem",
        F.coalesce(
            "problem",
            F.when(F.col("system_id").isNull(), "system_unknown"),
            F.when(F.col("x").isNull(), "system_unplaced"),
        ),
    )


def scout_range(scouts: DataFrame, systems: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nearest systems of each valid request after all of its filters, at most ``limit`` each.

    ``scouts`` come from ``resolved_scouts``. The origin, hidden, avoided, too hot and (with
    ``avoid_gates``) gate-connected systems are dropped before anything is counted towards the limit.
    Requests that ask the same thing are answered once.
    """
    valid = scouts.where("problem is null").withColumn(
        "avoid_keys", F.array_sort(F.array_distinct(F.transform("avoid", lambda a: F.lower(a))))
    )
    question = ["system_id", "limit", "radius", "max_temperature", "avoid_gates", "include_dev", "avoid_keys"]
    valid = valid.withColumn("question", F.sha2(F.to_json(F.struct(*question)), 256))
    queries = valid.groupBy("question").agg(
        *[F.any_value(c).alias(c) for c in [*question, "x", "y", "z"]]
    ).select(
        F.col("question").alias("query_id"), "x", "y", "z", F.col("limit").alias("k"), "radius",
        "system_id", "max_temperature", "avoid_gates", "include_dev", "avoid_keys",
        F.col("max_temperature").alias("heat_limit"),
        (F.when(F.col("include_dev"), 0).otherwise(_HIDDEN) + F.when(F.col("avoid_gates"), _GATED).otherwise(0)).alias("shuns"),
    )
    # Besides itself a request rules out every system of a name it avoids.
    named = systems.groupBy(F.lower("name").alias("name_key")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
    queries = queries.join(F.broadcast(named)).withColumn("slack", 1 + F.size("avoid_keys") * F.coalesce("most", F.lit(0))).drop("most")
    gated = pairs.select(F.col("src").alias("id")).distinct().withColumn("gated", F.lit(True))
    targets = systems.select(
        "id", "x", "y", "z", "min_external_temp",
        F.lower("name").alias("name_key"),
        is_developer_system(F.col("name")).alias("hidden"),
    ).join(gated, "id", "left")
    tags = F.when(F.col("hidden"), _HIDDEN).otherwise(0) + F.when(F.col("gated").isNotNull(), _GATED).otherwise(0)
    targets = targets.withColumns({"heat": F.col("min_external_temp"), "tags": tags})
    keep = (
        (F.col("id") != F.col("system_id"))
        & F.coalesce(F.col("min_external_temp") <= F.col("max_temperature"), F.lit(True))
        & (F.col("include_dev") | ~F.col("hidden"))
        & ~F.array_contains("avoid_keys", F.col("name_key"))
        & (~F.col("avoid_gates") | F.col("gated").isNull())
    )
    found = nearest(queries, targets, keep=keep)
    details = systems.select("id", *DETAILS, F.col("x"), F.col("y"), F.col("z"))
    answered = found.join(shuffled_side(details, systems.count()), "id").withColumnRenamed("query_id", "question")
    # Many requests may ask the same; their answers are looked up without gathering them in one task.
    asked = valid.select("request_id", "question")
    return spread_lookup(asked, answered, "question", by="request_id", rows=found.count()).select(
        "request_id", "rank", F.col("id").alias("system_id"), "distance", *DETAILS, "x", "y", "z"
    )


def within_of(
    anchors: DataFrame,
    systems: DataFrame,
    radius_ly: float,
    metres_per_ly: float = METRES_PER_LIGHT_YEAR_FIXTURE,
) -> DataFrame:
    """Systems within a radius of anchors (``anchor_id, x, y, z``), the anchors included.

    Positions are in the map's light-years; the radius uses the rounder light-year of fixture
    extraction, so the distance is converted before it is compared and reported.
    """
    factor = metres_per_ly / METRES_PER_LIGHT_YEAR
    # A hair of slack in the join keeps the comparison below, in converted units, the only judge.
    near = radius_join(
        anchors.withColumnRenamed("anchor_id", "query_id"),
        systems.select("id", "x", "y", "z").where("x is not null"),
        radius_ly * factor * (1 + 1e-9),
    )
    return near.select(
        F.col("query_id").alias("anchor_id"), "id", (F.col("distance") / F.lit(factor)).alias("distance_ly")
    ).where(F.col("distance_ly") <= radius_ly)


def system_details(systems: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each system with the gates that leave it: one row per gate, one with nulls where there is none."""
    targets = systems.select(F.col("id").alias("gate_id"), F.col("name").alias("gate_name"))
    named = pairs.select(F.col("src").alias("gate_src"), F.col("dst").alias("gate_id")).join(targets, "gate_id")
    return systems.join(named, systems["id"] == named["gate_src"], "left").drop("gate_src")


def connected(anchors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Anchors and everything one gate away in either direction: distinct ``id``."""
    there = pairs.join(anchors.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    back = pairs.join(anchors.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return anchors.select("id").unionByName(there).unionByName(back).distinct()


# --- visiting tours -----------------------------------------------------------------------------------

_STOP = "struct<rank:int,system_id:bigint,x:double,y:double,z:double>"
_VISIT = "struct<step:int,system_id:bigint,distance:double>"


def _visit_nearest(acc: Column) -> Column:
    """Go to the nearest stop left; equal distances go to the better-ranked one."""
    reach = F.transform(
        acc["left"],
        lambda s: F.struct(
            distance(acc["x"], acc["y"], acc["z"], s["x"], s["y"], s["z"]).alias("distance"), s.alias("stop")
        ),
    )
    # A one-element array binds the choice, so that it is worked out once.
    gone = F.transform(
        F.array(F.array_min(reach)),
        lambda c: F.struct(
            c["stop"]["x"].alias("x"),
            c["stop"]["y"].alias("y"),
            c["stop"]["z"].alias("z"),
            F.filter(acc["left"], lambda s: s["rank"] != c["stop"]["rank"]).alias("left"),
            F.array_append(
                acc["visits"],
                F.struct(
                    (F.size(acc["visits"]) + 1).alias("step"),
                    c["stop"]["system_id"].alias("system_id"),
                    c["distance"].alias("distance"),
                ),
            ).alias("visits"),
        ),
    )
    return F.element_at(gone, 1)


def tours(found: DataFrame, scouts: DataFrame) -> DataFrame:
    """Order each request's systems as a greedy tour from its origin: steps from 1 with hop distances.

    Inherently one stop after another, so each request is folded by itself, inside the JVM; a request has
    at most as many stops as the scout limit allows. Requests with the same origin and stops share a tour.
    """
    origins = scouts.select("request_id", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"))
    stop = F.struct("rank", "system_id", "x", "y", "z")
    stops = found.groupBy("request_id").agg(F.array_sort(F.collect_list(stop)).cast(f"array<{_STOP}>").alias("stops"))
    asked = stops.join(shuffled_side(origins, origins.count()), "request_id").withColumn(
        "question", F.sha2(F.to_json(F.struct("ox", "oy", "oz", "stops")), 256)
    )
    asked = written(asked, "tour-questions")
    start = F.struct(
        F.col("ox").alias("x"),
        F.col("oy").alias("y"),
        F.col("oz").alias("z"),
        F.col("stops").alias("left"),
        F.array().cast(f"array<{_VISIT}>").alias("visits"),
    )
    visits = F.aggregate(
        F.sequence(F.lit(1), F.size("stops")), start, lambda acc, _: _visit_nearest(acc), lambda acc: acc["visits"]
    )
    # Only the first request of each question is folded; the fold sits behind a shuffle of small rows.
    distinct = asked.groupBy("question").agg(*[F.any_value(c).alias(c) for c in ("ox", "oy", "oz", "stops")])
    folded, rows = counted(distinct.select("question", visits.alias("visits")), "tours")
    # Requests that ask the same look the one tour up without meeting in one task.
    same = spread_lookup(asked.select("request_id", "question"), folded, "question", "request_id", rows)
    return same.select("request_id", F.inline("visits"))


def tour_with_ship(tour: DataFrame, scouts: DataFrame, systems: DataFrame) -> DataFrame:
    """Fuel (mass always follows the tank) and heat of every tour hop.

    ``scouts`` carry the ship columns of ``with_ship``, ``fuel_quality`` and ``heat_calibration``. A hop
    of zero length costs no fuel.
    """
    load = [
        "ship_name", "ship_base_mass_kg", "ship_specific_heat", "loaded_fuel", "loaded_cargo", "fuel_quality",
        "heat_calibration",
    ]
    ships = scouts.where("ship_name is not null").select("request_id", "system_id", "origin_temp", *load)
    origin = ships.select(
        "request_id", F.lit(0).alias("step"), "system_id", F.lit(None).cast("double").alias("distance")
    )
    stops = tour.join(ships.select("request_id"), "request_id", "left_semi").unionByName(origin)
    ambient = systems.select(F.col("id").alias("system_id"), "min_external_temp")
    hops = with_neighbours(stops.join(ambient, "system_id", "left"), "request_id", "step", ["system_id", "min_external_temp"])
    hops = hops.join(ships.drop("system_id", "origin_temp"), "request_id").withColumns(
        {
            "method": F.when(F.col("step") > 0, "jump"),
            "dynamic_mass": F.lit(True),
            "origin_temp": F.col("prev_min_external_temp"),
            "is_goal": F.col("next_system_id").isNull(),
            "next_is_gate": F.lit(False),
        }
    )
    hops = written(hops, "tour-hops")
    fuel = fold_fuel(hops, invalid_cost=0.0).withColumnRenamed("warning", "fuel_warning")
    heat = hop_heat(hops).withColumnRenamed("warning", "heat_warning")
    return (
        hops.where("step > 0").select("request_id", "step", "system_id", "distance")
        .join(fuel, ["request_id", "step"])
        .join(heat, ["request_id", "step"])
    )


def tour_totals(projected: DataFrame) -> DataFrame:
    """Stops, distance, fuel, wait (null when there is none) and final temperature per tour."""
    wait = F.sum("wait_seconds")
    return projected.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("stops"),
        F.sum("distance").alias("total_distance"),
        F.max_by("cumulative", "step").alias("total_fuel"),
        F.when(wait > 0, wait).alias("total_wait_seconds"),
        F.coalesce(F.max_by("residual", F.when(F.col("residual").isNotNull(), F.col("step"))), F.lit(HEAT_NOMINAL)).alias(
            "final_heat"
        ),
    )
