"""Queries on requests, routes, scouting and tours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylane.functions.ship_physics import (
    DEFAULT_CALIBRATION,
    cooling_constant,
    heat_distance_cap,
    jump_fuel,
    jump_heat_energy,
    maximum_distance,
    total_mass,
    with_heat,
    zone_factor,
)
from skylane.functions.text import cooldown_text, whole_units
from skylane.operators import edges, enrich, names, requests, scout, search
from skylane.plans import route_planner
from skylane.plans.registry import PARTS, query, r4, r6
from skylane.plans.sample_map import SampleMap
from skylane.session import written
from skylane.sources import datasets
from skylane.sources.ships import with_ship

# --- physics over whole tables ------------------------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, round(mass, 4) AS mass,
              round(CASE WHEN q BETWEEN 1 AND 100 THEN mass / 1e5 * (q / 1e2) * d END, 6) AS fuel,
              round(f * (q / 1e2) * 1e5 / mass, 6) AS reach,
              round(3e0 * mass * d / (1e-7 * hull) / 1e6, 6) AS energy_e6,
              round(3e0 * mass * d / (1e-7 * hull) / (mass * c), 6) AS rise,
              round(CASE WHEN 15e1 - amb > 0 THEN (15e1 - amb) * (1e-7 * hull * c) / 3e0 END, 6) AS heat_cap,
              zone, round(1e6 * zone / (mass * c), 9) AS k
       FROM (SELECT *, CASE WHEN amb <= 30 THEN 1e0 WHEN amb <= 100 THEN 7e-1 WHEN amb <= 300 THEN 4e-1
                            WHEN amb <= 1000 THEN 2e-1 ELSE 5e-2 END AS zone
             FROM (SELECT *, l_extendedprice * 1e3 AS hull, l_extendedprice * 1e3 + l_quantity * 30 + 5e3 AS mass,
                          l_quantity AS d, l_quantity * 30 AS f, l_discount * 1200 AS q, 5e-1 + l_tax * 5 AS c,
                          l_tax * 20000 AS amb FROM lineitem))""",
)
def ship_physics(m: SampleMap) -> DataFrame:
    """Mass, fuel, reach, heat and cooling formulas, one row per line item."""
    hull, quality, away = F.col("l_extendedprice") * 1e3, F.col("l_discount") * 1200, F.col("l_quantity").cast("double")
    fuel, heat, ambient = away * 30, 0.5 + F.col("l_tax") * 5, F.col("l_tax") * 20000
    calibration = F.lit(DEFAULT_CALIBRATION)
    mass = total_mass(hull, fuel, F.lit(5e3))
    energy = jump_heat_energy(mass, away, hull, calibration)
    return m.source("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        r4(mass).alias("mass"),
        r6(jump_fuel(mass, quality, away)).alias("fuel"),
        r6(maximum_distance(fuel, mass, quality)).alias("reach"),
        r6(energy / 1e6).alias("energy_e6"),
        r6(energy / (mass * heat)).alias("rise"),
        r6(heat_distance_cap(ambient, hull, heat, calibration)).alias("heat_cap"),
        zone_factor(ambient).alias("zone"),
        F.round(cooling_constant(mass, heat, ambient), 9).alias("k"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, warning, round(wait, 4) AS wait,
              CASE WHEN s >= 60 THEN concat(CAST(s // 60 AS VARCHAR), 'm', CAST(s % 60 AS VARCHAR), 's')
                   ELSE concat(CAST(s AS VARCHAR), 's') END AS wait_text,
              CAST(ceil(round(arrival, 6)) AS BIGINT) AS whole_kelvin,
              round(CASE WHEN cools AND wait > 0 THEN greatest(30e0, amb + 1e-2) ELSE arrival END, 6) AS residual
       FROM (SELECT *, CAST(round(least(greatest(coalesce(wait, 0e0), 0e0), 86400e0)) AS BIGINT) AS s FROM (
         SELECT *, CASE WHEN cools AND arrival > greatest(30e0, amb + 1e-2)
                        THEN -ln((greatest(30e0, amb + 1e-2) - amb) / (arrival - amb)) / k END AS wait
         FROM (SELECT *, CASE WHEN arrival >= 150 THEN 'CRITICAL' WHEN arrival >= 90 THEN 'OVERHEATED' END AS warning,
                      arrival > 30 AND l_linestatus = 'O' AS cools,
                      1e6 * CASE WHEN amb <= 30 THEN 1e0 ELSE 7e-1 END / (mass * 9e-1) AS k
               FROM (SELECT *, l_tax * 1e3 AS amb, l_discount * 400 + l_extendedprice / 3e4 + 3e0 * l_quantity / 9e-1 AS arrival,
                            1e7 + l_extendedprice AS mass FROM lineitem))))""",
)
def heat_projections(m: SampleMap) -> DataFrame:
    """Heat of a jump per line item: warning, wait, residual and its renderings."""
    mass, ambient = 1e7 + F.col("l_extendedprice"), F.col("l_tax") * 1e3
    away, origin = F.col("l_quantity").cast("double"), F.col("l_discount") * 400 + F.col("l_extendedprice") / 3e4
    projected = with_heat(
        m.source("lineitem"), "heat", mass=mass, specific_heat=F.lit(0.9), hull_mass=F.lit(1e7),
        calibration=F.lit(DEFAULT_CALIBRATION), distance=away, origin_ambient=origin, here_ambient=ambient,
        is_goal=F.col("l_linestatus") != "O", next_is_gate=F.lit(False),
    )
    arrival = origin + F.col("heat.hop_heat")
    return projected.select(
        "l_orderkey", "l_linenumber", "heat.warning", r4("heat.wait_seconds").alias("wait"),
        cooldown_text(F.coalesce("heat.wait_seconds", F.lit(0.0))).alias("wait_text"),
        whole_units(r6(arrival)).alias("whole_kelvin"), r6("heat.residual").alias("residual"),
    )


# --- request validation -------------------------------------------------------------------------------------


@query(
    """SELECT event_id AS request_id,
              CASE WHEN user_id = 3 THEN 'from_missing'
                   WHEN event_type = 'error' AND value < 5 THEN 'to_missing'
                   WHEN event_type = 'signup' AND value > 90 THEN 'algorithm_unknown'
                   WHEN value - 2 <= 0 THEN 'max_jump_range'
                   WHEN 400 - value <= 0 THEN 'max_temperature_range'
                   WHEN event_type = 'view' AND value > 80 THEN 'ship_blank'
                   WHEN NOT (value BETWEEN 1 AND 100) THEN 'fuel_quality_range'
                   WHEN 95 - value < 0 THEN 'cargo_mass_range'
                   WHEN 92 - value < 0 THEN 'fuel_load_range'
                   WHEN CAST(floor(value) AS INTEGER) - 40 < 0 THEN 'max_spatial_neighbors_range'
                   WHEN event_type = 'purchase' AND user_id % 2 = 0 THEN 'same_ends' END AS problem
       FROM events""",
)
def route_request_problems(m: SampleMap) -> DataFrame:
    value, kind = F.col("value"), F.col("event_type")
    asked = m.source("events").select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("user_id") == 3, "  ").otherwise("A").alias("from_name"),
        F.when((kind == "error") & (value < 5), "")
        .when((kind == "purchase") & (F.col("user_id") % 2 == 0), "A")
        .otherwise("B")
        .alias("to_name"),
        F.when((kind == "signup") & (value > 90), "walk").alias("algorithm"),
        (value - 2).alias("max_jump"),
        (400 - value).alias("max_temperature"),
        F.when((kind == "view") & (value > 80), " ").alias("ship"),
        value.alias("fuel_quality"),
        (95 - value).alias("cargo_mass"),
        (92 - value).alias("fuel_load"),
        (F.floor(value).cast("int") - 40).alias("max_spatial_neighbors"),
    )
    checked = requests.checked(requests.route_requests(asked), requests.route_problem(reject_same_ends=True))
    return checked.select("request_id", "problem")


@query(
    """SELECT event_id AS request_id,
              CASE WHEN user_id = 3 THEN 'system_missing'
                   WHEN floor(value) < 1 THEN 'limit_range'
                   WHEN value - 4 <= 0 THEN 'radius_range'
                   WHEN 90 - value <= 0 THEN 'max_temperature_range'
                   WHEN event_type = 'view' THEN 'radius_missing' END AS problem,
              round(CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 15e1 ELSE 90 - value END, 6) AS cap
       FROM events""",
)
def scout_request_problems(m: SampleMap) -> DataFrame:
    value, kind = F.col("value"), F.col("event_type")
    asked = m.source("events").select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("user_id") == 3, "").otherwise("A").alias("system"),
        F.floor(value).cast("int").alias("limit"),
        F.when(~((kind == "view") & (value > 4)), value - 4).alias("radius"),
        (90 - value).alias("max_temperature"),
        (kind == "click").alias("avoid_critical_state"),
        (F.col("user_id") % 2 == 1).alias("no_avoid_critical_state"),
    )
    checked = requests.checked(requests.scout_requests(asked), requests.scout_problem(radius_required=True))
    return checked.select("request_id", "problem", r6(requests.effective_scout_temperature()).alias("cap"))


# --- edge predicates ------------------------------------------------------------------------------------------

# How a request's ship, mode and objective turn into edge prices and limits, in plain SQL.
_PROFILES = """
asked AS (
  SELECT r.*, f.id AS start, g.id AS goal, a.id AS avoid_id, s.name AS ship_name, s.base_mass_kg AS hull,
         s.specific_heat AS heat, s.fuel_capacity AS load,
         CASE WHEN avoid_gates THEN 'spatial' WHEN algorithm = 'bfs' THEN 'gate' ELSE 'hybrid' END AS mode,
         f.min_external_temp AS start_ambient, f.star_temperature AS start_star, g.star_temperature AS goal_star
  FROM route_requests r LEFT JOIN systems f ON f.name = from_name LEFT JOIN systems g ON g.name = to_name
  LEFT JOIN systems a ON a.name = avoid_name
  LEFT JOIN ships s ON lower(s.name) = lower(trim(coalesce(ship, 'Reflex')))),
staged AS (
  SELECT *, CASE WHEN start IS NULL OR goal IS NULL OR (avoid_name IS NOT NULL AND avoid_id IS NULL) THEN 'unknown_system'
                 WHEN coalesce(avoid_id IN (start, goal), false) OR coalesce(start_star > max_temperature, false)
                   OR coalesce(goal_star > max_temperature, false) THEN 'not_found' ELSE 'open' END AS stage,
         least(max_jump, CASE WHEN avoid_critical_state AND 150 - coalesce(start_ambient, 0e0) > 0
                              THEN (150 - coalesce(start_ambient, 0e0)) * (1e-7 * hull * heat) / 3e0 END) AS max_length,
         CASE WHEN algorithm = 'bfs' THEN 'hops' WHEN optimization = 'fuel' THEN 'fuel' ELSE 'distance' END AS objective,
         (hull + load) / 1e5 * (fuel_quality / 1e2) AS per_ly
  FROM asked),
links AS MATERIALIZED (
  SELECT src, dst, kind, distance, star_temperature, coalesce(min_external_temp, 0e0) AS ambient,
         min_external_temp
  FROM (SELECT src, dst, kind, distance FROM gates UNION ALL SELECT src, dst, 'spatial', distance FROM nearest8)
  JOIN systems ON id = dst)
"""

_ALLOWED = """
  (kind = 'gate' AND mode <> 'spatial')
  OR (kind = 'spatial' AND mode <> 'gate' AND (max_length IS NULL OR distance <= max_length)
      AND (max_temperature IS NULL OR star_temperature IS NULL OR star_temperature <= max_temperature)
      AND (NOT avoid_critical_state OR ambient + 3e0 / (1e-7 * hull * heat) * distance < 150)
      AND (objective <> 'fuel' OR distance > 0))"""

_ROUTE_PARTS = ("route_requests", "ships", "systems", "gates", "nearest8")


def _route_profiles(m: SampleMap, **fixed: str | bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolved requests with given columns fixed, all edges for 8 neighbours, and the systems."""
    systems = written(m.systems, "systems")
    asked = m.route_requests.withColumns({k: F.lit(v) for k, v in fixed.items()})
    resolved = written(
        route_planner.resolved_requests(asked, systems, m.ships, "Reflex")
        .withColumn("graph_id", F.lit(1))
        .withColumn("neighbours", F.col("max_spatial_neighbors"))
        .withColumn("max_star_temperature", F.col("max_temperature")),
        "resolved",
    )
    gates = edges.gate_edges(m.pairs, systems)
    jumps = edges.neighbour_edges(systems, edges.graph_table(m.spark, [edges.NeighbourGraph(neighbours=8)]))
    return resolved, search.edge_table(gates, jumps, systems), systems


@query(
    "WITH RECURSIVE " + _PROFILES + f"""
    SELECT request_id, count(*) AS edges, count(*) FILTER (kind = 'spatial') AS jumps,
           count(*) FILTER (max_length IS NULL OR distance <= max_length OR kind = 'gate') AS short_enough,
           count(*) FILTER (kind = 'gate' OR max_temperature IS NULL OR star_temperature IS NULL
                            OR star_temperature <= max_temperature) AS cool_enough,
           count(*) FILTER (kind = 'gate' OR NOT avoid_critical_state
                            OR ambient + 3e0 / (1e-7 * hull * heat) * distance < 150) AS safe,
           count(*) FILTER ({_ALLOWED}) AS allowed
    FROM staged JOIN links ON src = start WHERE stage = 'open' GROUP BY request_id""",
    _ROUTE_PARTS,
)
def edge_filters(m: SampleMap) -> DataFrame:
    """Edges out of every request's start that pass each predicate, and all of them."""
    resolved, table, _ = _route_profiles(m)
    rows = resolved.where("status = 'open'").drop("kind").join(table.drop("graph_id"), F.col("start") == F.col("src"))
    return rows.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_if(F.col("kind") == "spatial").alias("jumps"),
        F.count_if(search.within_distance()).alias("short_enough"),
        F.count_if(search.within_star_temperature()).alias("cool_enough"),
        F.count_if(search.within_heat()).alias("safe"),
        F.count_if(search.allowed() & search.within_neighbours()).alias("allowed"),
    )


# --- searches ----------------------------------------------------------------------------------------------------

_SEARCH_SQL = (
    "WITH RECURSIVE "
    + _PROFILES
    + """,
prof AS MATERIALIZED (SELECT * FROM (SELECT * EXCLUDE (mode, objective, algorithm, stage), {algorithm} AS algorithm,
    {mode} AS mode, {objective} AS objective, stage FROM staged) WHERE stage = 'open'),
reach(request_id, node, cost) USING KEY (request_id, node) AS (
  SELECT request_id, start, 0e0 FROM prof
  UNION
  SELECT c.request_id, c.node, c.cost FROM (
    SELECT r.request_id, l.dst AS node, min(r.cost + CASE objective WHEN 'hops' THEN 1e0 WHEN 'distance' THEN distance
             ELSE CASE WHEN kind = 'gate' THEN 0e0 ELSE per_ly * distance END END) AS cost
    FROM reach r JOIN prof p ON p.request_id = r.request_id JOIN links l ON l.src = r.node
    WHERE (avoid_id IS NULL OR l.dst <> avoid_id) AND ("""
    + _ALLOWED
    + """)
    GROUP BY r.request_id, l.dst) c
  LEFT JOIN recurring.reach k ON k.request_id = c.request_id AND k.node = c.node
  WHERE k.cost IS NULL OR c.cost < k.cost)
"""
)
_FOUND = "SELECT p.request_id, node IS NOT NULL AS found, {cost} FROM prof p LEFT JOIN reach r ON r.request_id = p.request_id AND r.node = p.goal"


def _search_sql(algorithm: str, mode: str, objective: str, cost: str = "round(cost, 6) AS cost") -> str:
    # Plain replacement: the text holds braces of its own kind nowhere else.
    text = _SEARCH_SQL
    for name, value in (("algorithm", algorithm), ("mode", mode), ("objective", objective)):
        text = text.replace("{" + name + "}", value)
    return text + _FOUND.replace("{cost}", cost)


_ANY_MODE = "CASE WHEN avoid_gates THEN 'spatial' ELSE 'hybrid' END"


def _searched(m: SampleMap, **fixed: str | bool) -> DataFrame:
    resolved, table, systems = _route_profiles(m, **fixed)
    asked = resolved.where("status = 'open'")
    avoided = asked.select("request_id", F.explode("avoid_ids").alias("node"))
    return search.search(asked, table, systems, avoided)[0]


@query(
    _search_sql("'bfs'", "CASE WHEN avoid_gates THEN 'spatial' ELSE 'gate' END", "'hops'", "CAST(cost AS INTEGER) AS hops"),
    _ROUTE_PARTS,
)
def routes_fewest_hops(m: SampleMap) -> DataFrame:
    return _searched(m, algorithm="bfs").select("request_id", "found", "hops")


@query(_search_sql("'dijkstra'", _ANY_MODE, "'distance'"), _ROUTE_PARTS)
def routes_shortest_distance(m: SampleMap) -> DataFrame:
    """Without the straight-line bound."""
    resolved, table, systems = _route_profiles(m, algorithm="dijkstra", optimization="distance")
    asked = resolved.where("status = 'open'").withColumn("ahead_rate", F.lit(0.0))
    avoided = asked.select("request_id", F.explode("avoid_ids").alias("node"))
    arrivals, _ = search.search(asked, table, systems, avoided)
    return arrivals.select("request_id", "found", r6("cost").alias("cost"))


@query(_search_sql("'a-star'", _ANY_MODE, "'distance'"), _ROUTE_PARTS)
def routes_goal_directed(m: SampleMap) -> DataFrame:
    found = _searched(m, algorithm="a-star", optimization="distance")
    return found.select("request_id", "found", r6("cost").alias("cost"))


@query(_search_sql("'dijkstra'", _ANY_MODE, "'fuel'"), _ROUTE_PARTS)
def routes_least_fuel(m: SampleMap) -> DataFrame:
    found = _searched(m, algorithm="dijkstra", optimization="fuel")
    return found.select("request_id", "found", r6("cost").alias("cost"))


@query(_search_sql("'bfs'", "'gate'", "'hops'", "CAST(cost AS INTEGER) AS hops"), _ROUTE_PARTS)
def routes_through_gates(m: SampleMap) -> DataFrame:
    """Fewest gate hops for every request."""
    found = _searched(m, algorithm="bfs", avoid_gates=False)
    return found.select("request_id", "found", "hops")


@query(_search_sql("'a-star'", "'hybrid'", "'distance'"), _ROUTE_PARTS)
def routes_by_gate_or_jump(m: SampleMap) -> DataFrame:
    """Shortest distance for every request, gates always allowed."""
    found = _searched(m, algorithm="a-star", optimization="distance", avoid_gates=False)
    return found.select("request_id", "found", r6("cost").alias("cost"))


@query(_search_sql("algorithm", "mode", "objective", "CAST(0 AS BIGINT) AS undercut"), _ROUTE_PARTS)
def route_certificates(m: SampleMap) -> DataFrame:
    """Every answer proved by its reached costs, which no allowed edge undercuts, whatever the request's objective."""
    resolved, table, systems = _route_profiles(m)
    asked = resolved.where("status = 'open'")
    avoided = asked.select("request_id", F.explode("avoid_ids").alias("node"))
    return search.search(asked, table, systems, avoided, settle=True)[0].select("request_id", "found", "undercut")


_PLAN_SQL = _search_sql("algorithm", "mode", "objective").replace(
    _FOUND.replace("{cost}", "round(cost, 6) AS cost"), ""
) + """
SELECT s.request_id, s.mode, s.objective,
       CASE WHEN stage <> 'open' THEN stage WHEN r.node IS NOT NULL THEN 'ok' ELSE 'not_found' END AS status,
       round(r.cost, 6) AS cost, round(s.max_length, 6) AS max_length,
       CASE WHEN stage <> 'unknown_system' AND r.node IS NULL THEN
         CASE WHEN max_jump IS NULL AND NOT avoid_gates AND max_temperature IS NULL AND NOT avoid_critical_state
              THEN 'algorithm'
              ELSE concat_ws(',', CASE WHEN max_jump IS NOT NULL THEN 'max_jump' END, CASE WHEN avoid_gates THEN 'avoid_gates' END,
                     CASE WHEN max_temperature IS NOT NULL THEN 'max_temperature' END,
                     CASE WHEN avoid_critical_state THEN 'avoid_critical_state' END,
                     CASE WHEN avoid_critical_state AND ship_name IS NULL THEN 'ship' END)
         END END AS advice
FROM staged s LEFT JOIN reach r ON r.request_id = s.request_id AND r.node = s.goal AND s.stage = 'open'"""


@query(_PLAN_SQL, _ROUTE_PARTS)
def planned_routes(m: SampleMap) -> DataFrame:
    """Every request planned with its own algorithm, objective, ship and limits."""
    plans = route_planner.plan_routes(m.route_requests, m.systems, m.pairs, m.ships, suggest=False)
    return plans.summary.select(
        "request_id", "mode", "objective", "status", r6("cost").alias("cost"), r6("max_length").alias("max_length"), "advice"
    )


@query(
    _PLAN_SQL.replace(
        "SELECT s.request_id, s.mode, s.objective,",
        "SELECT request_id, mode, status, found, broken, round(cost_gap, 6) AS cost_gap FROM (SELECT s.request_id, s.mode, "
        "r.node IS NOT NULL AS found, CAST(0 AS BIGINT) AS broken, CASE WHEN r.node IS NOT NULL THEN 0e0 END AS cost_gap, s.objective,",
    ).replace("AND s.stage = 'open'", "AND s.stage = 'open') WHERE found"),
    _ROUTE_PARTS,
)
def planned_route_steps(m: SampleMap) -> DataFrame:
    """The rebuilt steps of every found route, proved: start and goal, existing edges, and the price.

    ``broken`` counts steps without an edge or an end in the wrong place; ``cost_gap`` is the search cost less the
    cost summed along the steps.
    """
    systems = written(m.systems, "systems")
    plans = route_planner.plan_routes(m.route_requests, systems, m.pairs, m.ships, suggest=False)
    rows = plans.steps.join(
        plans.summary.select(
            "request_id", "mode", "status", "graph_id", "objective", "cost", "start", "goal", "step", "gate_rate",
            "jump_rate", "priced", "max_length", F.col("max_spatial_neighbors").alias("neighbours"),
            F.col("max_temperature").alias("max_star_temperature"), "heat_per_ly",
        ).withColumnRenamed("step", "hop_price"),
        "request_id",
    )
    placed = enrich.with_neighbours(rows, "request_id", "step", ["system_id"])
    legs = placed.withColumnRenamed("step", "at").withColumnRenamed("hop_price", "step").join(
        plans.edges.select(
            F.col("src").alias("prev_system_id"), F.col("dst").alias("system_id"), F.col("graph_id").alias("edge_graph"),
            "kind", "distance", "rank", "dst_star_temperature", "dst_ambient",
        ),
        ["prev_system_id", "system_id"],
        "left",
    )
    usable = F.when(
        ((F.col("edge_graph") == 0) | (F.col("edge_graph") == F.col("graph_id"))) & search.allowed(), search.price()
    )
    prices = legs.groupBy(
        "request_id", "at", "mode", "status", "cost", "start", "goal", "system_id", "prev_system_id", "next_system_id"
    ).agg(F.min(usable).alias("leg"))
    wrong = (
        (F.col("prev_system_id").isNotNull() & F.col("leg").isNull())
        | (F.col("prev_system_id").isNull() & (F.col("system_id") != F.col("start")))
        | (F.col("next_system_id").isNull() & (F.col("system_id") != F.col("goal")))
    )
    return prices.groupBy("request_id", "mode", "status", "cost").agg(
        F.count_if(wrong).alias("broken"), F.coalesce(F.sum("leg"), F.lit(0.0)).alias("walked")
    ).select(
        "request_id", "mode", "status", F.lit(True).alias("found"), "broken",
        F.abs(r6(F.col("cost") - F.col("walked"))).alias("cost_gap"),
    )


@query(
    """SELECT request_id, query, suggestions FROM (
         SELECT query, string_agg(name, '|' ORDER BY similarity DESC, name) AS suggestions FROM (
           SELECT query, name, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, name) AS rank
           FROM (SELECT query, name, jaro_winkler_similarity(query, name) AS similarity
                 FROM (SELECT DISTINCT system AS query FROM scout_requests WHERE system NOT IN (SELECT name FROM bare)),
                      (SELECT DISTINCT name FROM bare))
           WHERE similarity >= 7e-1 QUALIFY rank <= 3) GROUP BY query)
       JOIN (SELECT request_id, system FROM scout_requests) ON system = query""",
    ("scout_requests", "bare"),
)
def unknown_system_suggestions(m: SampleMap) -> DataFrame:
    """Suggestions for every scout request that names an unknown system."""
    missing = names.unresolved(m.scout_requests, m.bare_systems, "system")
    lists = names.suggestion_lists(missing, names.name_index(m.bare_systems))
    return m.scout_requests.join(lists, F.col("system") == F.col("query")).select(
        "request_id", "query", F.concat_ws("|", "suggestions").alias("suggestions")
    )


@query(
    """SELECT request_id, algorithm, optimization, fuel_quality, ship AS ship_name, avoid_critical_state,
              max_spatial_neighbors, avoid_gates, max_jump FROM route_requests""",
    ("route_requests",),
)
def request_parameters(m: SampleMap) -> DataFrame:
    echo = requests.route_requests(m.route_requests).select("request_id", requests.parameters_echo().alias("p"))
    return echo.select("request_id", "p.*")


# --- enrichment of a whole corpus ------------------------------------------------------------------------------------


def _corpus_hops(m: SampleMap, *attributes: str, systems: DataFrame | None = None) -> DataFrame:
    """Hops of the corpus. Of the systems' columns only the places, temperatures and ``attributes`` go along."""
    located = enrich.with_systems(m.corpus_walks, written(m.systems, "systems") if systems is None else systems)
    return enrich.with_hops(located.select("request_id", "step", "system_id", "x", "y", "z", "min_external_temp", *attributes), m.pairs)


def _loaded_hops(m: SampleMap) -> DataFrame:
    """Corpus hops with a ship, load and mass mode per route."""
    route = F.col("request_id")
    ship = F.when(route % 3 == 0, "Reflex").when(route % 3 == 1, "Forager").otherwise("Warden")
    asked = m.corpus_walks.select("request_id").distinct().select(
        "request_id",
        ship.alias("ship"),
        F.lit(None).cast("double").alias("fuel_load"),
        (route % 7 * 1000).cast("double").alias("cargo_mass"),
        (5 + route % 20).cast("double").alias("fuel_quality"),
        (route % 2 == 1).alias("dynamic_mass"),
        F.lit(DEFAULT_CALIBRATION).alias("heat_calibration"),
    )
    hops = _corpus_hops(m).select(
        "request_id", "step", "distance", "method", "min_external_temp", "origin_temp", "is_goal", "next_is_gate"
    )
    return hops.join(with_ship(asked, m.ships), "request_id")


@query(
    """SELECT request_id, step, system_id, name, round(distance, 6) AS distance, method,
              round(min_external_temp, 6) AS min_external_temp, round(origin_temp, 6) AS origin_temp,
              next_id IS NULL AS is_goal, next_is_gate,
              CASE WHEN step = 0 THEN 'STRT' WHEN next_id IS NULL THEN 'GOAL' WHEN method = 'gate' THEN 'GATE' ELSE 'JUMP' END AS tag,
              CASE WHEN step = 0 THEN 0 WHEN method = 'gate' THEN 2 ELSE 1 END AS waypoint_type
       FROM hops""",
    ("hops",),
)
def route_hops(m: SampleMap) -> DataFrame:
    """Hop distance, method, neighbours and labels of every corpus step."""
    return enrich.with_labels(_corpus_hops(m, "name")).select(
        "request_id", "step", "system_id", "name", r6("distance").alias("distance"), "method",
        r6("min_external_temp").alias("min_external_temp"), r6("origin_temp").alias("origin_temp"), "is_goal",
        "next_is_gate", "tag", "waypoint_type",
    )


@query(
    """SELECT request_id, count(*) - 1 AS hops, round(coalesce(sum(distance), 0), 4) AS total_distance,
              round(coalesce(sum(distance) FILTER (method = 'jump'), 0), 4) AS jump_distance,
              round(coalesce(sum(distance), 0) - coalesce(sum(distance) FILTER (method = 'jump'), 0), 4) AS gate_distance,
              min_by(system_id, step) AS start_id, max_by(system_id, step) AS goal_id
       FROM hops GROUP BY request_id""",
    ("hops",),
)
def route_totals(m: SampleMap) -> DataFrame:
    hops = _corpus_hops(m)
    totals = enrich.route_totals(hops).join(enrich.route_endpoints(m.corpus_walks), "request_id")
    return totals.withColumns({c: r4(c) for c in ("total_distance", "jump_distance", "gate_distance")})


@query(
    """SELECT request_id, count(*) FILTER (step > 0 AND method = 'gate') AS gates,
              count(*) FILTER (step > 0 AND method = 'jump') AS jumps FROM hops GROUP BY request_id
       HAVING count(*) > 1""",
    ("hops",),
)
def hop_kinds(m: SampleMap) -> DataFrame:
    """Gates and jumps by the shortest edge between steps, where jumps join all steps without a gate."""
    systems = written(m.systems, "systems")
    hops = _corpus_hops(m, systems=systems).withColumns({"mode": F.lit("hybrid"), "graph_id": F.lit(1)})
    direct = hops.where("prev_system_id is not null").select(
        F.lit(1).alias("graph_id"), F.col("prev_system_id").alias("src"), F.col("system_id").alias("dst"),
        F.lit("spatial").alias("kind"), "distance", F.lit(None).cast("int").alias("rank"),
    ).distinct()
    table = search.edge_table(edges.gate_edges(m.pairs, m.bare_systems), direct, systems)
    return enrich.hop_kinds(hops, table)


@query(
    """SELECT request_id, step, round(cost, 6) AS hop_cost, round(total, 6) AS cumulative,
              round(greatest(fuel_load - total, 0), 6) AS remaining
       FROM (SELECT *, sum(cost) OVER (PARTITION BY request_id ORDER BY step) AS total FROM (
         SELECT h.request_id, step, fuel_load, (base_mass_kg + fuel_load + cargo) / 1e5 * (quality / 1e2) * distance AS cost
         FROM hops h JOIN loads l ON l.request_id = h.request_id WHERE method = 'jump' AND distance > 0))""",
    ("hops", "loads"),
)
def running_fuel(m: SampleMap) -> DataFrame:
    """Constant-mass fuel along the jumps of every corpus route, without refuelling."""
    jumps = _loaded_hops(m).where("method = 'jump' and distance > 0")
    return enrich.running_fuel(jumps).select(
        "request_id", "step", r6("hop_cost").alias("hop_cost"), r6("cumulative").alias("cumulative"),
        r6("remaining").alias("remaining"),
    )


_FOLD_SQL = """WITH RECURSIVE legs AS MATERIALIZED (
  SELECT h.request_id, step, distance, method = 'gate' AS is_gate, l.* EXCLUDE (request_id)
  FROM hops h JOIN loads l ON l.request_id = h.request_id),
fold AS (
  SELECT request_id, step, fuel_load AS remaining, 0e0 AS cumulative, 0e0 AS hop_cost, CAST(NULL AS VARCHAR) AS warning
  FROM legs WHERE step = 0
  UNION ALL
  SELECT request_id, step, CASE WHEN cost IS NULL THEN NULL WHEN {short} THEN fuel_load ELSE greatest(before - cost, 0) END,
         total + cost, cost, CASE WHEN {short} THEN 'REFUEL' END
  FROM (SELECT l.request_id, l.step, l.fuel_load, l.is_gate, f.remaining AS before, f.cumulative AS total,
               CASE WHEN l.is_gate THEN 0e0 WHEN l.distance > 0 THEN
                 (base_mass_kg + cargo + CASE WHEN dynamic_mass THEN f.remaining ELSE fuel_load END) / 1e5
                 * (quality / 1e2) * l.distance END AS cost
        FROM fold f JOIN legs l ON l.request_id = f.request_id AND l.step = f.step + 1))
"""


@query(
    _FOLD_SQL.replace("{short}", "NOT is_gate AND cost > before")
    + """SELECT request_id, CAST(step AS INTEGER) AS step, round(hop_cost, 6) AS hop_cost, round(cumulative, 6) AS cumulative,
         round(remaining, 6) AS remaining, warning FROM fold WHERE step > 0""",
    ("hops", "loads"),
)
def folded_fuel(m: SampleMap) -> DataFrame:
    """Fuel with refuelling, at constant or dynamic mass, along every corpus route."""
    return enrich.fold_fuel(_loaded_hops(m)).select(
        "request_id", "step", r6("hop_cost").alias("hop_cost"), r6("cumulative").alias("cumulative"),
        r6("remaining").alias("remaining"), "warning",
    )


@query(
    _FOLD_SQL.replace("{short}", "false")
    + """SELECT request_id, CAST(step AS INTEGER) AS step, round(hop_cost, 6) AS hop_cost, round(remaining, 6) AS remaining
         FROM fold WHERE step > 0""",
    ("hops", "loads"),
)
def folded_fuel_without_refuel(m: SampleMap) -> DataFrame:
    """The plain recurrence: the tank runs down to zero and stays there."""
    return enrich.fold_fuel(_loaded_hops(m), refuel=False).select(
        "request_id", "step", r6("hop_cost").alias("hop_cost"), r6("remaining").alias("remaining")
    )


@query(
    _FOLD_SQL.replace("{short}", "NOT is_gate AND cost > before")
    + """SELECT request_id, round(total, 6) AS total, refuelled,
         round(CASE WHEN refuelled THEN fuel_load WHEN dynamic_mass THEN last_remaining ELSE greatest(fuel_load - total, 0) END, 6)
           AS remaining
       FROM (SELECT request_id, arg_max_null(cumulative, step) AS total, bool_or(warning IS NOT NULL) AS refuelled,
                    arg_max_null(remaining, step) AS last_remaining FROM fold WHERE step > 0 GROUP BY request_id)
       JOIN loads USING (request_id)""",
    ("hops", "loads"),
)
def fuel_summaries(m: SampleMap) -> DataFrame:
    hops = written(_loaded_hops(m).select("request_id", "step", "distance", "method", *enrich.LOAD), "loaded-hops")
    return enrich.fuel_summary(hops, enrich.fold_fuel(hops)).withColumns(
        {c: r6(c) for c in ("total", "remaining")}
    )


_HEAT_SQL = """
heat AS (
  SELECT request_id, step, rise, warning, wait, CASE WHEN NOT moving THEN 30e0 WHEN wait IS NOT NULL THEN floor_k ELSE arrival END AS residual
  FROM (SELECT *, CASE WHEN arrival >= 150 AND moving THEN 'CRITICAL' WHEN arrival >= 90 AND moving THEN 'OVERHEATED' END AS warning,
               CASE WHEN moving AND arrival > 30 AND next_id IS NOT NULL AND NOT next_is_gate AND arrival > floor_k
                    THEN -ln((floor_k - around) / (arrival - around)) / k END AS wait
        FROM (SELECT *, greatest(coalesce(origin_temp, 0e0), 0e0) + rise AS arrival, greatest(30e0, around + 1e-2) AS floor_k,
                     1e6 * CASE WHEN min_external_temp IS NULL THEN 1e-1 WHEN around <= 30 THEN 1e0 WHEN around <= 100 THEN 7e-1
                                ELSE 4e-1 END / ((base_mass_kg + fuel_load + cargo) * specific_heat) AS k
              FROM (SELECT h.*, l.* EXCLUDE (request_id), coalesce(min_external_temp, 0e0) AS around,
                           method = 'jump' AND distance > 0 AS moving,
                           CASE WHEN method = 'jump' THEN 3e0 * distance / (1e-7 * base_mass_kg) / specific_heat ELSE 0e0 END AS rise
                    FROM hops h JOIN loads l ON l.request_id = h.request_id WHERE step > 0))))
"""


@query(
    "WITH RECURSIVE " + _HEAT_SQL + """
    SELECT request_id, step, round(rise, 6) AS hop_heat, warning, round(wait, 4) AS wait_seconds, round(residual, 6) AS residual
    FROM heat""",
    ("hops", "loads"),
)
def hop_heat(m: SampleMap) -> DataFrame:
    return enrich.hop_heat(_loaded_hops(m)).select(
        "request_id", "step", r6("hop_heat").alias("hop_heat"), "warning", r4("wait_seconds").alias("wait_seconds"),
        r6("residual").alias("residual"),
    )


@query(
    "WITH RECURSIVE " + _HEAT_SQL + """
    SELECT request_id, round(coalesce(sum(wait), 0), 4) AS total_wait_seconds, round(max_by(residual, step), 6) AS final_residual,
           coalesce(string_agg(warning, ',' ORDER BY step) FILTER (warning IS NOT NULL), '') AS warnings
    FROM heat GROUP BY request_id""",
    ("hops", "loads"),
)
def heat_summaries(m: SampleMap) -> DataFrame:
    summary = enrich.heat_summary(enrich.hop_heat(_loaded_hops(m)))
    return summary.select(
        "request_id", r4("total_wait_seconds").alias("total_wait_seconds"), r6("final_residual").alias("final_residual"),
        F.concat_ws(",", "warnings").alias("warnings"),
    )


_PRICE = "CASE objective WHEN 'hops' THEN 1e0 WHEN 'distance' THEN distance ELSE CASE WHEN kind = 'gate' THEN 0e0 ELSE per_ly * distance END END"

# The planned routes themselves: cheapest, then shortest arrivals, and of equal ways the smallest previous system.
_WALKS_SQL = (
    "WITH RECURSIVE "
    + _PROFILES
    + f""",
prof AS MATERIALIZED (SELECT * FROM staged WHERE stage = 'open'),
reach(request_id, node, cost, hops) USING KEY (request_id, node) AS (
  SELECT request_id, start, 0e0, 0 FROM prof
  UNION
  SELECT c.request_id, c.node, c.best.cost, c.best.hops FROM (
    SELECT r.request_id, l.dst AS node, min({{'cost': r.cost + {_PRICE}, 'hops': r.hops + 1}}) AS best
    FROM reach r JOIN prof p ON p.request_id = r.request_id JOIN links l ON l.src = r.node
    WHERE (avoid_id IS NULL OR l.dst <> avoid_id) AND ({_ALLOWED})
    GROUP BY r.request_id, l.dst) c
  LEFT JOIN recurring.reach k ON k.request_id = c.request_id AND k.node = c.node
  WHERE k.cost IS NULL OR c.best.cost < k.cost OR (c.best.cost = k.cost AND c.best.hops < k.hops)),
walk(request_id, node, step, cost) AS (
  SELECT p.request_id, r.node, r.hops, r.cost FROM prof p JOIN reach r ON r.request_id = p.request_id AND r.node = p.goal
  UNION ALL
  SELECT request_id, src, step - 1, cost FROM (
    SELECT w.request_id, l.src, w.step, u.cost
    FROM walk w JOIN prof p ON p.request_id = w.request_id JOIN links l ON l.dst = w.node
    JOIN reach u ON u.request_id = w.request_id AND u.node = l.src
    WHERE w.step > 0 AND u.hops + 1 = w.step AND u.cost + {_PRICE} = w.cost AND (avoid_id IS NULL OR l.dst <> avoid_id) AND ({_ALLOWED})
    QUALIFY row_number() OVER (PARTITION BY w.request_id ORDER BY l.src) = 1)),
walks AS MATERIALIZED (SELECT request_id, step, node AS system_id FROM walk),
hops AS MATERIALIZED ({PARTS["hops"][1]}),
loads AS MATERIALIZED (
  SELECT request_id, ship_name, hull AS base_mass_kg, heat AS specific_heat, load AS fuel_load, 0e0 AS cargo, fuel_quality AS quality, dynamic_mass
  FROM prof WHERE ship_name IS NOT NULL),
"""
)


@query(
    _WALKS_SQL
    + _FOLD_SQL.replace("{short}", "NOT is_gate AND cost > before").removeprefix("WITH RECURSIVE ").rstrip()
    + ","
    + _HEAT_SQL
    + """,
    way AS (SELECT request_id, count(*) - 1 AS hops, sum(coalesce(distance, 0)) AS total, sum(CASE WHEN method = 'jump' THEN distance ELSE 0 END) AS jumped,
                   min_by(system_id, step) AS start_id, max_by(system_id, step) AS goal_id,
                   count(*) FILTER (step > 0 AND method = 'gate') AS gate_hops FROM hops GROUP BY request_id),
    burnt AS (SELECT request_id, arg_max_null(cumulative, step) AS total, bool_or(warning IS NOT NULL) AS refuelled,
                     arg_max_null(remaining, step) AS last_remaining FROM fold WHERE step > 0 GROUP BY request_id),
    warmed AS (SELECT request_id, coalesce(sum(wait), 0) AS wait, max_by(residual, step) AS residual,
                      string_agg(warning, ',' ORDER BY step) FILTER (warning IS NOT NULL) AS warnings FROM heat GROUP BY request_id)
    SELECT w.request_id, start_id, goal_id, w.hops, CASE WHEN mode = 'spatial' THEN 0 ELSE gate_hops END AS gates,
           CASE WHEN mode = 'spatial' THEN w.hops ELSE w.hops - gate_hops END AS jumps,
           round(w.total, 6) AS total_distance, round(jumped, 6) AS jump_distance, round(b.total, 6) AS fuel_total,
           round(CASE WHEN b.request_id IS NULL THEN NULL WHEN refuelled THEN fuel_load WHEN l.dynamic_mass THEN last_remaining
                      ELSE greatest(fuel_load - b.total, 0) END, 6) AS fuel_remaining,
           refuelled, round(wait, 4) AS total_wait_seconds, round(residual, 6) AS final_residual, coalesce(warnings, '') AS warnings
    FROM way w JOIN prof p ON p.request_id = w.request_id LEFT JOIN loads l ON l.request_id = w.request_id
    LEFT JOIN burnt b ON b.request_id = w.request_id LEFT JOIN warmed h ON h.request_id = w.request_id""",
    _ROUTE_PARTS,
)
def enriched_route_summaries(m: SampleMap) -> DataFrame:
    """Planned routes with distance, method, fuel and heat rolled up per request."""
    systems = written(m.systems, "systems")
    plans = route_planner.plan_routes(m.route_requests, systems, m.pairs, m.ships, suggest=False)
    _, summary = route_planner.enriched_routes(plans, systems, m.pairs)
    return summary.select(
        "request_id", "start_id", "goal_id", "hops", "gates", "jumps", r6("total_distance").alias("total_distance"),
        r6("jump_distance").alias("jump_distance"), r6("fuel_total").alias("fuel_total"),
        r6("fuel_remaining").alias("fuel_remaining"), "refuelled", r4("total_wait_seconds").alias("total_wait_seconds"),
        r6("final_residual").alias("final_residual"), F.concat_ws(",", "warnings").alias("warnings"),
    )



@query(
    """SELECT request_id, count(*) - 1 AS hops, count(*) AS steps, min_by(system_id, step) AS start_id,
              max_by(system_id, step) AS goal_id, string_agg(CAST(system_id AS VARCHAR), ',' ORDER BY step) AS ids,
              count(*) FILTER (method = 'gate') AS gate_steps
       FROM hops GROUP BY request_id""",
    ("hops",),
)
def route_documents(m: SampleMap) -> DataFrame:
    """Route documents written as JSON and read back."""
    hops = _corpus_hops(m, "name", "planet_count", "moon_count")
    summary = enrich.route_totals(hops).join(enrich.route_endpoints(hops), "request_id")
    shape = (
        "hops bigint, start struct<id:bigint>, goal struct<id:bigint>, "
        "steps array<struct<step:int,id:bigint,name:string,distance:double,method:string>>"
    )
    doc = datasets.route_documents(summary, hops).select("request_id", F.from_json("document", shape).alias("d"))
    ids = F.transform("d.steps", lambda s: s["id"].cast("string"))
    return doc.select(
        "request_id", "d.hops", F.size("d.steps").cast("long").alias("steps"), F.col("d.start.id").alias("start_id"),
        F.col("d.goal.id").alias("goal_id"), F.array_join(ids, ",").alias("ids"),
        F.size(F.filter("d.steps", lambda s: s["method"] == "gate")).cast("long").alias("gate_steps"),
    )


# --- scouting ----------------------------------------------------------------------------------------------------------


@query(
    """SELECT r.request_id, s.id AS system_id, n.id AS neighbour_id, n.name, round(n.min_external_temp, 6) AS min_external_temp,
              n.planet_count, n.moon_count
       FROM scout_requests r JOIN (SELECT name, min(id) AS id FROM systems GROUP BY name) s ON s.name = r.system
       JOIN pairs p ON p.src = s.id JOIN systems n ON n.id = p.dst
       WHERE include_dev OR NOT regexp_full_match(n.name, '(AD|V-)[0-9]+')""",
    ("scout_requests", "systems", "pairs"),
)
def scout_gates(m: SampleMap) -> DataFrame:
    """Gate neighbours for every scout request."""
    systems = written(m.systems, "systems")
    asked = names.resolve(m.scout_requests, systems, "system").where("system_id is not null")
    return scout.by_name(scout.scout_gates(asked, m.pairs, systems)).withColumn(
        "min_external_temp", r6("min_external_temp")
    )


_RANGE_SQL = """WITH RECURSIVE valid AS MATERIALIZED (
  SELECT request_id, s.id AS origin, "limit" AS lim, radius, max_temperature, include_dev
  FROM scout_requests r JOIN (SELECT name, min(id) AS id FROM systems GROUP BY name) s ON s.name = r.system),
found AS MATERIALIZED (
  SELECT v.*, g.dst, g.distance, n.name, n.min_external_temp, n.planet_count, n.moon_count, n.x, n.y, n.z,
         row_number() OVER (PARTITION BY v.origin, lim, radius, max_temperature, include_dev ORDER BY g.distance, g.dst) AS rank
  FROM (SELECT DISTINCT origin, lim, radius, max_temperature, include_dev FROM valid) v
  JOIN gaps g ON g.src = v.origin JOIN systems n ON n.id = g.dst
  WHERE (radius IS NULL OR distance <= radius)
    AND (max_temperature IS NULL OR n.min_external_temp IS NULL OR n.min_external_temp <= max_temperature)
    AND (include_dev OR NOT regexp_full_match(n.name, '(AD|V-)[0-9]+')) QUALIFY rank <= lim),
answers AS MATERIALIZED (
  SELECT v.request_id, v.origin, f.* EXCLUDE (origin, lim, radius, max_temperature, include_dev) FROM valid v
  JOIN found f ON f.origin = v.origin AND f.lim = v.lim AND f.radius IS NOT DISTINCT FROM v.radius
   AND f.max_temperature IS NOT DISTINCT FROM v.max_temperature AND f.include_dev = v.include_dev)
"""


def _scouts(m: SampleMap) -> tuple[DataFrame, DataFrame, DataFrame]:
    systems = written(m.systems, "systems")
    scouts = written(scout.resolved_scouts(m.scout_requests, systems), "scouts")
    return scouts, scout.scout_range(scouts, systems, m.pairs), systems


@query(
    _RANGE_SQL
    + """SELECT request_id, CAST(rank AS INTEGER) AS rank, dst AS system_id, name, round(distance, 6) AS distance,
         round(min_external_temp, 6) AS min_external_temp, planet_count, moon_count FROM answers""",
    ("scout_requests", "systems", "gaps"),
)
def scout_range(m: SampleMap) -> DataFrame:
    """Filtered nearest systems for every scout request."""
    found = _scouts(m)[1]
    return found.select(
        "request_id", "rank", "system_id", "name", r6("distance").alias("distance"),
        r6("min_external_temp").alias("min_external_temp"), "planet_count", "moon_count",
    )


@query(
    """WITH RECURSIVE asked AS (
         SELECT s_suppkey AS request_id, 30000000 + (s_suppkey * 37 + 11) % (SELECT count(*) FROM customer) AS origin,
                s_nationkey % 2 = 0 AS avoid_gates,
                concat('customer#', lpad(CAST((s_suppkey * 53 + 5) % (SELECT count(*) FROM customer) AS VARCHAR), 9, '0')) AS avoid
         FROM supplier)
       SELECT request_id, dst AS system_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY distance, dst) AS INTEGER) AS rank,
              round(distance, 6) AS distance
       FROM asked JOIN gaps ON src = origin JOIN systems n ON n.id = dst
       WHERE distance <= 300 AND lower(n.name) <> avoid AND (NOT avoid_gates OR dst NOT IN (SELECT src FROM pairs))
         AND (min_external_temp IS NULL OR min_external_temp <= 150)
         AND NOT regexp_full_match(n.name, '(AD|V-)[0-9]+') QUALIFY rank <= 20""",
    ("gaps", "systems", "pairs"),
)
def scout_range_with_avoidance(m: SampleMap) -> DataFrame:
    """Systems named by id, avoided names in another case, gate-connected systems dropped, heat cap on."""
    total = "(SELECT count(*) FROM {customer})"
    asked = m.sql(
        f"""SELECT s_suppkey AS request_id, CAST(30000000 + (s_suppkey * 37 + 11) % {total} AS STRING) AS system,
                   s_nationkey % 2 = 0 AS avoid_gates,
                   array(concat('CUSTOMER#', lpad(CAST((s_suppkey * 53 + 5) % {total} AS STRING), 9, '0'))) AS avoid
            FROM {{supplier}}"""
    ).withColumns({"limit": F.lit(20), "radius": F.lit(300.0), "avoid_critical_state": F.lit(True)})
    systems = written(m.systems, "systems")
    scouts = scout.resolved_scouts(asked, systems, radius_required=True)
    found = scout.scout_range(scouts, systems, m.pairs)
    return found.select("request_id", "system_id", "rank", r6("distance").alias("distance"))


_TOUR_SQL = _RANGE_SQL + """,
tour(request_id, step, here, x, y, z, distance, seen) AS (
  SELECT DISTINCT a.request_id, 0, CAST(NULL AS BIGINT), s.x, s.y, s.z, 0e0, CAST([] AS BIGINT[])
  FROM answers a JOIN systems s ON s.id = a.origin
  UNION ALL
  SELECT request_id, step + 1, dst, x, y, z, d, list_append(seen, dst)
  FROM (SELECT t.request_id, t.step, t.seen, a.dst, a.x, a.y, a.z, a.rank,
               sqrt((t.x - a.x) * (t.x - a.x) + (t.y - a.y) * (t.y - a.y) + (t.z - a.z) * (t.z - a.z)) AS d
        FROM tour t JOIN answers a ON a.request_id = t.request_id
        WHERE NOT list_contains(t.seen, a.dst)
        QUALIFY row_number() OVER (PARTITION BY t.request_id ORDER BY d, a.rank) = 1))
"""


@query(
    _TOUR_SQL
    + """SELECT request_id, CAST(step AS INTEGER) AS step, here AS system_id, round(distance, 6) AS distance
         FROM tour WHERE step > 0""",
    ("scout_requests", "systems", "gaps"),
)
def scout_tours(m: SampleMap) -> DataFrame:
    """A greedy visiting order for the systems found by every scout request."""
    scouts, found, _ = _scouts(m)
    return scout.tours(found, scouts).withColumn("distance", r6("distance"))


def _tour_projection(m: SampleMap) -> DataFrame:
    scouts, found, systems = _scouts(m)
    shipped = with_ship(
        scouts.withColumns(
            {
                "ship": F.lit("Reflex"),
                "fuel_load": F.lit(300.0),
                "cargo_mass": F.lit(5000.0),
                "fuel_quality": F.lit(10.0),
                "heat_calibration": F.lit(DEFAULT_CALIBRATION),
            }
        ),
        m.ships,
    )
    return scout.tour_with_ship(scout.tours(found, scouts), written(shipped, "shipped-scouts"), systems)


_TOUR_FUEL_SQL = _TOUR_SQL + """,
fuel AS (
  SELECT request_id, 0 AS step, 300e0 AS remaining, 0e0 AS cumulative, 0e0 AS hop_cost, CAST(NULL AS VARCHAR) AS warning
  FROM tour WHERE step = 0
  UNION ALL
  SELECT request_id, step, CASE WHEN cost > before THEN 300e0 ELSE greatest(before - cost, 0) END, total + cost, cost,
         CASE WHEN cost > before THEN 'REFUEL' END
  FROM (SELECT t.request_id, t.step, f.remaining AS before, f.cumulative AS total,
               coalesce(CASE WHEN t.distance > 0 THEN (1e7 + 5e3 + f.remaining) / 1e5 * (1e1 / 1e2) * t.distance END, 0e0) AS cost
        FROM fuel f JOIN tour t ON t.request_id = f.request_id AND t.step = f.step + 1))
"""


@query(
    _TOUR_FUEL_SQL
    + """SELECT f.request_id, CAST(f.step AS INTEGER) AS step, here AS system_id, round(hop_cost, 6) AS hop_cost,
         round(cumulative, 6) AS cumulative, round(remaining, 6) AS remaining, warning AS fuel_warning,
         round(3e0 * distance / 9e-1, 6) AS hop_heat
       FROM fuel f JOIN tour t ON t.request_id = f.request_id AND t.step = f.step WHERE f.step > 0""",
    ("scout_requests", "systems", "gaps"),
)
def scout_tour_fuel(m: SampleMap) -> DataFrame:
    """Fuel at dynamic mass and heat along every tour."""
    return _tour_projection(m).select(
        "request_id", "step", "system_id", r6("hop_cost").alias("hop_cost"), r6("cumulative").alias("cumulative"),
        r6("remaining").alias("remaining"), "fuel_warning", r6("hop_heat").alias("hop_heat"),
    )


@query(
    _TOUR_FUEL_SQL
    + """,
    heat AS (
      SELECT *, CASE WHEN arrival > 30 AND NOT is_goal AND arrival > floor_k THEN -ln((floor_k - around) / (arrival - around)) / k END AS wait
      FROM (SELECT *, greatest(coalesce(origin_temp, 0e0), 0e0) + 3e0 * distance / 9e-1 AS arrival, greatest(30e0, around + 1e-2) AS floor_k
            FROM (SELECT t.request_id, t.step, t.distance, s.min_external_temp, coalesce(s.min_external_temp, 0e0) AS around,
                         lag(s.min_external_temp) OVER w AS origin_temp, lead(t.step) OVER w IS NULL AS is_goal,
                         1e6 * CASE WHEN s.min_external_temp IS NULL THEN 1e-1 WHEN s.min_external_temp <= 30 THEN 1e0
                                    WHEN s.min_external_temp <= 100 THEN 7e-1 ELSE 4e-1 END / ((1e7 + 5e3 + 300e0) * 9e-1) AS k
                  FROM tour t JOIN (SELECT request_id AS q, origin FROM valid) v ON v.q = t.request_id
                  JOIN systems s ON s.id = coalesce(t.here, v.origin)
                  WINDOW w AS (PARTITION BY t.request_id ORDER BY t.step))
            WHERE step > 0))
    SELECT request_id, count(*) AS stops, round(sum(distance), 4) AS total_distance,
           (SELECT round(max_by(cumulative, step), 4) FROM fuel f WHERE f.request_id = heat.request_id) AS total_fuel,
           round(CASE WHEN sum(wait) > 0 THEN sum(wait) END, 4) AS total_wait_seconds,
           round(max_by(CASE WHEN distance = 0 THEN 30e0 WHEN wait IS NOT NULL THEN floor_k ELSE arrival END, step), 6) AS final_heat
    FROM heat GROUP BY request_id""",
    ("scout_requests", "systems", "gaps"),
)
def scout_tour_totals(m: SampleMap) -> DataFrame:
    totals = scout.tour_totals(_tour_projection(m))
    return totals.select(
        "request_id", "stops", r4("total_distance").alias("total_distance"), r4("total_fuel").alias("total_fuel"),
        r4("total_wait_seconds").alias("total_wait_seconds"), r6("final_heat").alias("final_heat"),
    )


@query(
    _RANGE_SQL
    + """SELECT request_id, count(*) AS systems, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY rank) AS ids
         FROM answers GROUP BY request_id""",
    ("scout_requests", "systems", "gaps"),
)
def scout_documents(m: SampleMap) -> DataFrame:
    """Scout answers written as JSON and read back."""
    found = _scouts(m)[1]
    doc = datasets.scout_documents(found).select(
        "request_id", F.from_json("document", "count bigint, systems array<struct<id:bigint>>").alias("d")
    )
    ids = F.transform("d.systems", lambda s: s["id"].cast("string"))
    return doc.select("request_id", F.col("d.count").alias("systems"), F.array_join(ids, ",").alias("ids"))


@query(
    """SELECT b.id, b.name, b.constellation_name, g.id AS gate_id, g.name AS gate_name
       FROM bare b LEFT JOIN (SELECT src, id, name FROM pairs JOIN bare ON id = dst) g ON g.src = b.id""",
    ("bare", "pairs"),
)
def system_details(m: SampleMap) -> DataFrame:
    listed = scout.system_details(m.bare_systems, m.pairs)
    return listed.select("id", "name", "constellation_name", "gate_id", "gate_name")


@query(
    """SELECT id FROM (
         SELECT solarSystemId AS id FROM raw_systems WHERE regionId = 1
         UNION SELECT dst FROM pairs WHERE src IN (SELECT solarSystemId FROM raw_systems WHERE regionId = 1)
         UNION SELECT src FROM pairs WHERE dst IN (SELECT solarSystemId FROM raw_systems WHERE regionId = 1))""",
    ("raw_systems", "pairs"),
)
def connected_systems(m: SampleMap) -> DataFrame:
    """One region's systems and everything a gate away from them."""
    anchors = m.bare_systems.where("region_id = 1").select("id")
    return scout.connected(anchors, m.pairs)


@query(
    """SELECT a.id AS anchor_id, b.id, round(d, 6) AS distance_ly FROM (
         SELECT a.id, b.id AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))
                * 9.4607304725808e15 / 9.461e15 AS d
         FROM bare a JOIN bare b ON a.id IN (SELECT 30000000 + s_suppkey FROM supplier)) a JOIN bare b ON b.id = other
       WHERE d <= 80""",
    ("bare",),
)
def systems_within(m: SampleMap) -> DataFrame:
    """Everything within 80 light-years (by the rounder unit) of each supplier's system."""
    at = m.source("supplier").select((F.col("s_suppkey") + 30_000_000).alias("anchor_id"))
    anchors = at.join(m.bare_systems, F.col("anchor_id") == F.col("id")).select("anchor_id", "x", "y", "z")
    found = scout.within_of(anchors, m.bare_systems, 80.0)
    return found.withColumn("distance_ly", r6("distance_ly"))
