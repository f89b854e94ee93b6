"""Planning a whole table of route requests: resolve, check, limit, search, re-check, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.functions.ship_physics import fuel_rate, heat_distance_cap, heat_per_light_year, total_mass
from skylane.operators import enrich
from skylane.operators.edges import gate_edges, neighbour_edges
from skylane.operators.names import ROUTE_SUGGESTIONS, name_index, resolve, suggestion_lists, unresolved
from skylane.operators.requests import checked, endpoint_blocked, failure_advice, route_problem, route_requests
from skylane.operators.search import PROFILE, edge_table, rebuild_paths, search
from skylane.session import spread_lookup, written
from skylane.sources.ships import DEFAULT_SHIP, with_ship


@dataclass
class RoutePlans:
    """``summary`` has one row per request, ``steps`` the systems of each found route, ``edges`` the graphs used."""

    summary: DataFrame
    steps: DataFrame
    edges: DataFrame


def search_mode() -> Column:
    """Which edges a request may use: jumps only, gates only, or both."""
    return (
        F.when(F.col("avoid_gates"), "spatial").when(F.col("algorithm") == "bfs", "gate").otherwise("hybrid")
    )


def search_objective() -> Column:
    """hops, fuel or distance. Fuel needs a ship, else distance; a fewest-hops search ignores it."""
    return (
        F.when(F.col("algorithm") == "bfs", "hops")
        .when((F.col("optimization") == "fuel") & F.col("ship_name").isNotNull(), "fuel")
        .otherwise("distance")
    )


def cost_columns() -> dict[str, Column]:
    """Price columns of a profile from a request's mode, objective and ship."""
    mass = total_mass(F.col("ship_base_mass_kg"), F.col("loaded_fuel"), F.col("loaded_cargo"))
    objective, mode = F.col("objective"), F.col("mode")
    # Without a ship the heat of a jump cannot be judged, so a request that minds it gets no jumps.
    jumps = (mode != "gate") & ~(F.col("avoid_critical_state") & F.col("ship_name").isNull())
    rate = (
        F.when(objective == "hops", 0.0)
        .when(objective == "fuel", fuel_rate(mass, F.col("fuel_quality")))
        .otherwise(1.0)
    )
    return {
        "step": F.when(objective == "hops", 1.0).otherwise(0.0),
        "gate_rate": F.when(mode != "spatial", F.when(objective == "distance", 1.0).otherwise(0.0)),
        "jump_rate": F.when(jumps, rate),
        "priced": objective == "fuel",
        # With gates allowed a hop or a unit of fuel may cover any distance, so nothing bounds them.
        "ahead_rate": F.when(objective == "distance", 1.0)
        .when((mode == "spatial") & (objective == "fuel"), F.coalesce(rate, F.lit(0.0)))
        .when((mode == "spatial") & (F.col("max_length") > 0), 1.0 / F.col("max_length"))
        .otherwise(0.0),
        "heat_per_ly": F.when(
            F.col("avoid_critical_state"),
            heat_per_light_year(
                F.col("ship_base_mass_kg"), F.col("ship_specific_heat"), F.col("heat_calibration")
            ),
        ),
    }


def resolved_requests(requests: DataFrame, systems: DataFrame, ships: DataFrame, default_ship: str | None) -> DataFrame:
    """Requests with ids of both ends, the ship, avoided ids and a first ``status``.

    A failed check leaves ``status`` other than ``open``: invalid, unknown_ship, unknown_system or
    not_found (an end is avoided or too hot).
    """
    asked = checked(route_requests(requests), route_problem())
    asked = resolve(asked, systems, "from_name").withColumnRenamed("system_id", "start")
    asked = resolve(asked, systems, "to_name").withColumnRenamed("system_id", "goal")
    ends = systems.select("id", "star_temperature", "min_external_temp")
    asked = asked.join(
        ends.select(
            F.col("id").alias("start"),
            F.col("star_temperature").alias("start_star"),
            F.col("min_external_temp").alias("start_ambient"),
        ),
        "start",
        "left",
    ).join(ends.select(F.col("id").alias("goal"), F.col("star_temperature").alias("goal_star")), "goal", "left")
    named = asked.select("request_id", F.explode("avoid").alias("avoid_name"))
    avoided = (
        resolve(named, systems, "avoid_name")
        .groupBy("request_id")
        .agg(
            F.array_sort(F.collect_set("system_id")).alias("avoid_ids"),
            F.min(F.when(F.col("system_id").isNull(), F.col("avoid_name"))).alias("unknown_avoid"),
        )
    )
    asked = with_ship(asked.join(avoided, "request_id", "left"), ships, default_ship)
    asked = asked.withColumns({"mode": search_mode(), "objective": search_objective()})
    avoids = F.coalesce("avoid_ids", F.array().cast("array<bigint>"))
    ends_avoided = F.array_contains(avoids, F.col("start")) | F.array_contains(avoids, F.col("goal"))
    unknown = F.coalesce(
        F.when(F.col("start").isNull(), F.col("from_name")),
        F.when(F.col("goal").isNull(), F.col("to_name")),
        F.col("unknown_avoid"),
    )
    status = (
        F.when(F.col("problem").isNotNull(), "invalid")
        .when(F.col("ship_status") == "unknown", "unknown_ship")
        .when(~F.col("ship_status").isin("ok", "none"), "invalid")
        .when(unknown.isNotNull(), "unknown_system")
        .when(endpoint_blocked(F.col("start_star"), F.col("goal_star"), ends_avoided), "not_found")
        .otherwise("open")
    )
    bad_loadout = F.when(~F.col("ship_status").isin("ok", "none", "unknown"), F.col("ship_status"))
    cap = F.when(
        F.col("avoid_critical_state") & F.col("ship_name").isNotNull(),
        heat_distance_cap(
            F.col("start_ambient"), F.col("ship_base_mass_kg"), F.col("ship_specific_heat"), F.col("heat_calibration")
        ),
    )
    # Jumps without any bound, neither a radius nor a neighbour count, are not a graph that can be built.
    boundless = (
        (F.col("status") == "open")
        & F.col("jump_rate").isNotNull()
        & F.col("max_length").isNull()
        & (F.coalesce("max_spatial_neighbors", F.lit(0)) == 0)
    )
    return (
        asked.withColumn("status", status)
        # least() skips nulls: a missing limit sets none.
        .withColumn("max_length", F.least("max_jump", cap))
        .withColumns(cost_columns())
        .withColumn("problem", F.coalesce("problem", bad_loadout, F.when(boundless, "jumps_unbounded")))
        .withColumn("status", F.when(boundless, "invalid").otherwise(F.col("status")))
        .withColumn("unknown_name", F.when(F.col("status") == "unknown_system", unknown))
        .withColumn("avoid_ids", avoids)
    )


def with_graphs(open_requests: DataFrame, systems: DataFrame) -> DataFrame:
    """Requests with ``graph_id`` and ``ambient_limit``, what the graph asks of a target's ambient temperature.

    Rank and radius limits nest, so one graph serves all requests with one temperature limit, ranked and
    unranked apart: it is built for the largest neighbour count and radius among them, and each request then
    cuts it down. A limit that no system's ambient temperature exceeds is none.
    """
    hottest = systems.agg(F.max("min_external_temp").alias("hottest"))
    limited = open_requests.join(F.broadcast(hottest))  # one row
    ambient = F.when(F.col("max_temperature") < F.col("hottest"), F.col("max_temperature"))
    ranked = F.coalesce(F.col("max_spatial_neighbors"), F.lit(0)) > 0
    # A hash is number enough: nothing but equality is asked of it.
    graph_id = F.when(F.col("jump_rate").isNotNull(), F.xxhash64("ambient_limit", ranked))
    return limited.withColumn("ambient_limit", ambient).withColumn("graph_id", graph_id).drop("hottest")


def neighbour_graphs(shaped: DataFrame) -> DataFrame:
    """The table of distinct jump graphs a batch needs; it stays a table."""
    asked = shaped.where("graph_id is not null").groupBy("graph_id").agg(
        F.max(F.when(F.col("max_spatial_neighbors") > 0, F.col("max_spatial_neighbors"))).alias("k"),
        F.max("max_length").alias("widest"),
        F.bool_or(F.col("max_length").isNull()).alias("unbounded"),
        F.max("ambient_limit").alias("limit"),
    )
    return asked.select("graph_id", "k", F.when(~F.col("unbounded"), F.col("widest")).alias("radius"), "limit")


def plan_routes(
    requests: DataFrame,
    systems: DataFrame,
    pairs: DataFrame,
    ships: DataFrame,
    *,
    default_ship: str | None = DEFAULT_SHIP,
    suggest: bool = True,
) -> RoutePlans:
    """Plan every request of a table against one map.

    Requests that ask the same thing are searched once. ``status`` is ok, not_found, unknown_system,
     unknown_ship or invalid; not_found rows carry advice and unknown_system rows
    suggestions.
    """
    systems = written(systems, "systems")
    asked = written(resolved_requests(requests, systems, ships, default_ship), "requests")
    open_requests = asked.where("status = 'open'")
    shaped = written(with_graphs(open_requests, systems), "shaped")
    gates = gate_edges(pairs, systems)
    jumps = None if shaped.where("graph_id is not null").isEmpty() else neighbour_edges(systems, neighbour_graphs(shaped))
    edges = written(edge_table(gates, jumps, systems), "all-edges")

    shaped = shaped.select(
        "*",
        F.col("max_spatial_neighbors").alias("neighbours"),
        F.col("max_temperature").alias("max_star_temperature"),
    )
    question = [c for c in PROFILE if c != "request_id"] + ["avoid_ids"]
    shaped = shaped.withColumn("question", F.sha2(F.to_json(F.struct(*question)), 256))
    searches = written(
        shaped.groupBy("question").agg(
            F.min("request_id").alias("search_id"), *[F.any_value(c).alias(c) for c in question]
        ),
        "searches",
    )
    n_searches = searches.count()
    asks = written(
        spread_lookup(
            shaped.select("request_id", "graph_id", "mode", "question"),
            searches.select("question", "search_id"),
            "question",
            "request_id",
            n_searches,
        ).drop("question"),
        "asks",
    )
    profiles = searches.drop("question").withColumnRenamed("search_id", "request_id")
    avoided = profiles.select("request_id", F.explode("avoid_ids").alias("node"))
    arrivals, state = search(profiles, edges, systems, avoided, settle=True)
    paths = written(rebuild_paths(arrivals, state), "paths")

    answers = arrivals.select(
        F.col("request_id").alias("search_id"), "found", "cost"
    )
    found = spread_lookup(asks, answers, "search_id", "request_id", n_searches)
    steps = _steps_of(asks, paths)

    unsafe = written(_unsafe(steps, asked, asks, edges, systems), "unsafe")
    if not unsafe.isEmpty():
        steps, found = _replanned(unsafe, steps, found, profiles, asks, edges, systems)
        steps = written(steps, "replanned-steps")
    return RoutePlans(_summary(asked, found, systems, suggest), steps, edges)


def _steps_of(asks: DataFrame, paths: DataFrame) -> DataFrame:
    """Copy each search's path to every request that asked for it."""
    by_search = paths.withColumnRenamed("request_id", "search_id")
    return spread_lookup(
        asks.select("request_id", "search_id"), by_search, "search_id", "request_id", paths.count()
    ).drop("search_id")


_SHIP = [
    "avoid_critical_state", "ship_name", "ship_base_mass_kg", "ship_specific_heat", "loaded_fuel", "loaded_cargo",
    "heat_calibration",
]


def _unsafe(steps: DataFrame, asked: DataFrame, asks: DataFrame, edges: DataFrame, systems: DataFrame) -> DataFrame:
    """Requests whose route fails the heat re-check. Only requests with a ship can."""
    minded = asked.where("avoid_critical_state and ship_name is not null").select("request_id", *_SHIP)
    graph = asks.select("request_id", "graph_id", "mode")
    checked_steps = steps.join(minded, "request_id").join(graph, "request_id")
    ambient = systems.select(F.col("id").alias("system_id"), "min_external_temp")
    hops = enrich.with_neighbours(checked_steps.join(ambient, "system_id", "left"), "request_id", "step", ["system_id"])
    return enrich.unsafe_requests(hops, edges)


def _replanned(unsafe, steps, found, profiles, asks, edges, systems):
    """Search once more for the flagged requests, each under the limits that it had: the graph is shared by a
    batch, so a wider limit would let a request use jumps that only others asked for."""
    again = (
        asks.select("request_id", "search_id", "graph_id").join(unsafe, "request_id", "left_semi")
        .join(profiles.drop("graph_id").withColumnRenamed("request_id", "search_id"), "search_id")
    )
    avoided = again.select("request_id", F.explode("avoid_ids").alias("node"))
    arrivals, state = search(again, edges, systems, avoided, settle=True)
    paths = rebuild_paths(arrivals, state)
    kept_steps = steps.join(unsafe, "request_id", "left_anti").unionByName(paths)
    kept_found = found.join(unsafe, "request_id", "left_anti").select("request_id", "found", "cost", "graph_id", "mode")
    new_found = arrivals.select("request_id", "found", "cost").join(
        asks.select("request_id", "graph_id", "mode"), "request_id"
    )
    return kept_steps, kept_found.unionByName(new_found.select(*kept_found.columns))


def _summary(asked: DataFrame, found: DataFrame, systems: DataFrame, suggest: bool) -> DataFrame:
    outcome = found.select("request_id", "found", "cost", "graph_id")
    status = (
        F.when(F.col("status") != "open", F.col("status"))
        .when(F.col("found"), "ok")
        .otherwise("not_found")
    )
    rows = asked.join(outcome, "request_id", "left").withColumn("status", status)
    rows = rows.withColumn("advice", F.when(F.col("status") == "not_found", failure_advice("ship_name")))
    if not suggest:
        return rows.drop("found")
    missing = unresolved(rows.where("unknown_name is not null"), systems, "unknown_name")
    lists = suggestion_lists(missing, name_index(systems), ROUTE_SUGGESTIONS).withColumnRenamed("query", "unknown_name")
    return rows.join(lists, "unknown_name", "left").drop("found")


def route_hops(plans: RoutePlans, systems: DataFrame, pairs: DataFrame) -> DataFrame:
    """Steps of all found routes with systems, hops, labels and the request's ship and load columns."""
    carried = ["request_id", "mode", "graph_id", "fuel_quality", "dynamic_mass", *_SHIP]
    hops = enrich.with_labels(enrich.with_hops(enrich.with_systems(plans.steps, systems), pairs))
    return hops.join(plans.summary.select(*carried), "request_id")


def enriched_routes(plans: RoutePlans, systems: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hop table with fuel and heat, and one summary row per found route."""
    hops = written(route_hops(plans, systems, pairs), "hops")
    shipped = hops.where("ship_name is not null")
    fuel = enrich.fold_fuel(shipped)
    heat = enrich.hop_heat(shipped)
    widened = hops.join(
        fuel.withColumnRenamed("warning", "fuel_warning"), ["request_id", "step"], "left"
    ).join(heat.withColumnRenamed("warning", "heat_warning"), ["request_id", "step"], "left")
    totals = enrich.route_totals(hops)
    kinds = enrich.hop_kinds(hops, plans.edges)
    ends = enrich.route_endpoints(hops)
    fuel_totals = enrich.fuel_summary(shipped, fuel).select(
        "request_id", F.col("total").alias("fuel_total"), F.col("remaining").alias("fuel_remaining"), "refuelled"
    )
    heat_totals = enrich.heat_summary(heat)
    summary = (
        ends.join(totals, "request_id")
        .join(kinds, "request_id", "left")
        .join(fuel_totals, "request_id", "left")
        .join(heat_totals, "request_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("gates", "jumps")})
    )
    return widened, summary
