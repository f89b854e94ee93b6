"""Queries on the map itself: scans, celestials, edges, spatial joins, names, ships, datasets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylane.functions.temperature import (
    ambient_from_au,
    ambient_from_metres,
    inverse_tangent,
    logistic,
    stefan_boltzmann,
    temperature_problem,
)
from skylane.functions.text import is_black_hole, is_developer_system, temperature_band
from skylane.operators import celestial, edges, names, spatial
from skylane.plans.registry import query, r4, r6
from skylane.plans.sample_map import SHIP_CATALOGUE, SampleMap
from skylane.session import work_area
from skylane.sources import datasets, ships, starmap
from skylane.sources.starmap import read_tables

_SYSTEM_SQL = """
SELECT id, name, constellation_id, constellation_name, region_id, region_name, CAST(NULL AS DOUBLE) AS security_status,
       star_temperature, round(star_luminosity / 1e20, 6) AS luminosity_e20,
       round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM bare"""


@query(_SYSTEM_SQL, ("bare",))
def scan_systems(m: SampleMap) -> DataFrame:
    return m.bare_systems.withColumns({c: r6(c) for c in "xyz"}).withColumn(
        "luminosity_e20", r6(F.col("star_luminosity") / 1e20)
    ).drop("star_luminosity")


@query(
    """SELECT solarSystemId AS id, name, CAST(NULL AS BIGINT) AS constellation_id, CAST(NULL AS DOUBLE) AS x
       FROM raw_systems""",
    ("raw_systems",),
)
def scan_legacy_systems(m: SampleMap) -> DataFrame:
    return starmap.load_systems(m.legacy_tables).select("id", "name", "constellation_id", "x")


@query("SELECT fromSystemId AS src, toSystemId AS dst FROM raw_jumps", ("raw_jumps",))
def scan_jumps(m: SampleMap) -> DataFrame:
    return m.jumps


@query(
    """SELECT system_id, kind, round(x, 4) AS x_m, round(y, 4) AS y_m, round(z, 4) AS z_m FROM bodies
       WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL""",
    ("bodies",),
)
def scan_celestials(m: SampleMap) -> DataFrame:
    return starmap.placed_celestials(m.celestials).withColumns({c: r4(c) for c in ("x_m", "y_m", "z_m")})


@query("SELECT system_id, kind, count(*) AS bodies FROM bodies GROUP BY system_id, kind", ("bodies",))
def celestial_counts_by_kind(m: SampleMap) -> DataFrame:
    return celestial.tagged_counts(m.celestials)


@query(
    """SELECT system_id, round(outermost_m, 4) AS outermost_m FROM body_facts WHERE outermost_m IS NOT NULL""",
    ("body_facts",),
)
def outermost_body(m: SampleMap) -> DataFrame:
    return celestial.outermost_body(m.celestials).withColumn("outermost_m", r4("outermost_m"))


@query(
    """SELECT id, planet_count, moon_count, round(min_external_temp, 6) AS min_external_temp,
              id BETWEEN 30000001 AND 30000003 AS black_hole,
              CASE WHEN min_external_temp > 50 THEN 'hot' WHEN min_external_temp > 20 THEN 'warm' ELSE 'cool' END AS band
       FROM systems""",
    ("systems",),
)
def ambient_temperatures(m: SampleMap) -> DataFrame:
    return m.systems.select(
        "id", "planet_count", "moon_count", r6("min_external_temp").alias("min_external_temp"),
        is_black_hole(F.col("id")).alias("black_hole"), temperature_band(F.col("min_external_temp")).alias("band"),
    )


@query(
    """SELECT id, round(CASE WHEN star_luminosity > 0 AND outermost_m > 0 THEN
              1e-1 + 998e-1 / (1 + pow((outermost_m / 299792458e0) / (3.215e-11 * sqrt(star_luminosity)), 1.25e0)) END, 6)
              AS min_external_temp
       FROM bare LEFT JOIN body_facts ON system_id = id""",
    ("bare", "body_facts"),
)
def ambient_temperatures_logistic(m: SampleMap) -> DataFrame:
    warm = celestial.with_celestials(m.bare_systems, m.celestials, model="logistic")
    return warm.select("id", r6("min_external_temp").alias("min_external_temp"))


@query(
    """SELECT o_orderkey AS body, round(CASE WHEN c_acctbal > 0 THEN
                atan(sqrt(c_acctbal * 1e24 / ((o_totalprice / 1e2) * (o_totalprice / 1e2)) * 1e-21)) * (200e0 / pi()) END, 6) AS flux_k,
              round(CASE WHEN c_acctbal > 0 THEN 5e0 + 2e0 * (1e-1 + 998e-1
                / (1 + pow((o_totalprice / 1e2) / (3.215e-11 * sqrt(c_acctbal * 1e24)), 1.25e0))) END, 6) AS scaled_k,
              round(CASE WHEN c_acctbal > 0 THEN
                atan(sqrt(c_acctbal * 1e24 / ((o_totalprice * 1e6 / 299792458e0) * (o_totalprice * 1e6 / 299792458e0)) * 1e-21))
                * (200e0 / pi()) END, 6) AS metres_k,
              round(CASE WHEN c_acctbal > 0 THEN
                atan(sqrt(c_acctbal * 1e24 / ((o_totalprice / 1e4 * 1.495978707e11 / 299792458e0)
                  * (o_totalprice / 1e4 * 1.495978707e11 / 299792458e0)) * 1e-21)) * (200e0 / pi()) END, 6) AS au_k,
              round(CASE WHEN c_acctbal > 0 THEN pow(c_acctbal * 1e24 /
                (16 * pi() * 5.670374419e-8 * (o_totalprice * 1e6) * (o_totalprice * 1e6)), 25e-2) END, 4) AS black_body_k,
              CASE WHEN c_acctbal <= 0 THEN 'luminosity_range' END AS problem
       FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def temperature_models(m: SampleMap) -> DataFrame:
    """Every model and unit, one row per order: price as distance, the customer's balance as luminosity."""
    joined = m.source("orders").join(m.source("customer"), F.col("c_custkey") == F.col("o_custkey"))
    price, light = F.col("o_totalprice"), F.col("c_acctbal") * 1e24
    return joined.select(
        F.col("o_orderkey").alias("body"),
        r6(inverse_tangent(price / 1e2, light)).alias("flux_k"),
        r6(logistic(price / 1e2, light, offset=5.0, scale=2.0)).alias("scaled_k"),
        r6(ambient_from_metres(price * 1e6, light)).alias("metres_k"),
        r6(ambient_from_au(price / 1e4, light)).alias("au_k"),
        r4(stefan_boltzmann(price * 1e6, light)).alias("black_body_k"),
        temperature_problem(price, light).alias("problem"),
    )


@query(
    """WITH RECURSIVE pairwise AS (
                 SELECT name, min_external_temp AS t, 1e-1 + 998e-1
                   / (1 + pow((outermost_m / 299792458e0) / (3.215e-11 * sqrt(star_luminosity)), 1.25e0)) AS p
                 FROM systems JOIN body_facts ON system_id = id WHERE min_external_temp IS NOT NULL)
       SELECT count(*) AS readings, round(avg(abs(p - t)), 6) AS mean_error, round(max(abs(p - t)), 6) AS max_error,
              (SELECT name FROM pairwise ORDER BY abs(p - t) DESC, name LIMIT 1) AS worst,
              round(avg(CASE WHEN abs(p - t) <= 5e-2 * abs(t) THEN 1e0 ELSE 0e0 END), 6) AS share_close
       FROM pairwise""",
    ("systems", "body_facts"),
)
def model_accuracy(m: SampleMap) -> DataFrame:
    """The logistic model held against the inverse-tangent one."""
    outer = celestial.outermost_body(m.celestials)
    readings = m.systems.join(outer, F.col("id") == F.col("system_id")).where("min_external_temp is not null")
    predicted = ambient_from_metres(F.col("outermost_m"), F.col("star_luminosity"), "logistic")
    measured = readings.select("name", F.col("min_external_temp").alias("measured_k"), predicted.alias("predicted_k"))
    return celestial.model_accuracy(measured).withColumns(
        {c: r6(c) for c in ("mean_error", "max_error", "share_close")}
    )


# --- edges ------------------------------------------------------------------------------------------------


@query(
    """SELECT 'skipped' AS item, CAST(NULL AS BIGINT) AS id, count(*) AS jumps FROM raw_jumps
       WHERE fromSystemId NOT IN (SELECT solarSystemId FROM raw_systems)
          OR toSystemId NOT IN (SELECT solarSystemId FROM raw_systems)
       UNION ALL
       SELECT 'unknown_id', id, count(*) FROM (
         SELECT fromSystemId AS id FROM raw_jumps
         UNION ALL SELECT toSystemId FROM raw_jumps WHERE toSystemId <> fromSystemId)
       WHERE id NOT IN (SELECT solarSystemId FROM raw_systems) GROUP BY id""",
    ("raw_jumps", "raw_systems"),
)
def dangling_jumps(m: SampleMap) -> DataFrame:
    return edges.dangling_report(m.jumps, m.bare_systems)


@query("SELECT src, dst, kind, round(distance, 6) AS distance FROM gates", ("gates",))
def gate_edges(m: SampleMap) -> DataFrame:
    return edges.gate_edges(m.pairs, m.bare_systems).withColumn("distance", r6("distance"))


@query(
    """WITH RECURSIVE raw_ids AS (SELECT solarSystemId AS id FROM raw_systems)
       SELECT id AS src, dst FROM raw_ids LEFT JOIN pairs ON src = id""",
    ("pairs", "raw_systems"),
)
def adjacency_lists(m: SampleMap) -> DataFrame:
    return edges.adjacency(m.pairs, m.bare_systems)


@query(
    "SELECT src, dst, round(distance, 6) AS distance FROM gaps WHERE distance <= 45",
    ("gaps",),
)
def radius_join(m: SampleMap) -> DataFrame:
    found = edges.spatial_edges(m.systems, max_jump=45.0)
    return found.select("src", "dst", r6("distance").alias("distance"))


@query(
    "SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM nearest8",
    ("nearest8",),
)
def nearest_neighbours(m: SampleMap) -> DataFrame:
    found = edges.spatial_edges(m.systems, neighbours=8)
    return found.select("src", "dst", "rank", r6("distance").alias("distance"))


@query(
    """SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS INTEGER) AS rank,
              round(distance, 6) AS distance
       FROM gaps JOIN systems ON id = dst
       WHERE distance <= 80 AND (min_external_temp IS NULL OR min_external_temp <= 40) QUALIFY rank <= 5""",
    ("gaps", "systems"),
)
def spatial_graph(m: SampleMap) -> DataFrame:
    """Radius, temperature and neighbour limits together."""
    found = edges.spatial_edges(m.systems, max_jump=80.0, max_temperature=40.0, neighbours=5)
    return found.select("src", "dst", "rank", r6("distance").alias("distance"))


@query(
    """SELECT src, dst, kind, round(distance, 6) AS distance FROM gates
       UNION ALL SELECT src, dst, 'spatial', round(distance, 6) FROM nearest8""",
    ("gates", "nearest8"),
)
def hybrid_edges(m: SampleMap) -> DataFrame:
    merged = edges.merge_edges(
        edges.gate_edges(m.pairs, m.bare_systems), edges.spatial_edges(m.systems, neighbours=8)
    )
    return edges.edges_in_order(merged).withColumn("distance", r6("distance"))


@query(
    """WITH RECURSIVE points AS (
         SELECT vec_id, list_sum(list_transform(embedding[1:21], lambda v: CAST(v AS DOUBLE))) AS x,
                list_sum(list_transform(embedding[22:42], lambda v: CAST(v AS DOUBLE))) AS y,
                list_sum(list_transform(embedding[43:], lambda v: CAST(v AS DOUBLE))) AS z FROM embeddings)
       SELECT a.vec_id AS query_id, b.vec_id AS id,
              CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS INTEGER) AS rank, round(d, 6) AS distance
       FROM (SELECT a.vec_id, b.vec_id AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)
                    + (a.z - b.z) * (a.z - b.z)) AS d FROM points a JOIN points b ON a.vec_id <> b.vec_id) a
       JOIN points b ON b.vec_id = a.other QUALIFY rank <= 5""",
)
def nearest_vectors(m: SampleMap) -> DataFrame:
    """Nearest neighbours over real-valued points: the sums of each third of an embedding."""
    values = F.transform("embedding", lambda v: v.cast("double"))
    thirds = {"x": F.slice(values, 1, 21), "y": F.slice(values, 22, 21), "z": F.slice(values, F.lit(43), F.greatest(F.size(values) - 42, F.lit(0)))}
    points = m.source("embeddings").select(
        "vec_id", *[F.aggregate(part, F.lit(0.0), lambda s, v: s + v).alias(c) for c, part in thirds.items()]
    )
    found = spatial.nearest(
        points.select(F.col("vec_id").alias("query_id"), "x", "y", "z", F.lit(5).alias("k"),
                      F.lit(None).cast("double").alias("radius")),
        points.withColumnRenamed("vec_id", "id"),
        keep=F.col("query_id") != F.col("id"),
    )
    return found.withColumn("distance", r6("distance"))


# --- names -------------------------------------------------------------------------------------------------


@query(
    """SELECT request_id, system, CASE WHEN TRY_CAST(system AS BIGINT) IS NOT NULL THEN CAST(system AS BIGINT) ELSE id END
              AS system_id
       FROM scout_requests LEFT JOIN (SELECT name, min(id) AS id FROM bare GROUP BY name) ON name = system""",
    ("scout_requests", "bare"),
)
def resolve_names(m: SampleMap) -> DataFrame:
    found = names.resolve(m.scout_requests, m.bare_systems, "system", numeric_ids=True)
    return found.select("request_id", "system", "system_id")


@query(
    """SELECT DISTINCT system AS query FROM scout_requests WHERE system NOT IN (SELECT name FROM bare)""",
    ("scout_requests", "bare"),
)
def unresolved_names(m: SampleMap) -> DataFrame:
    return names.unresolved(m.scout_requests, m.bare_systems, "system")


_MISSPELT = "concat(substr(p_name, 1, 2), substr(p_name, 4))"


@query(
    f"""SELECT query, name, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, name) AS INTEGER) AS rank,
               round(similarity, 6) AS similarity
        FROM (SELECT query, name, jaro_winkler_similarity(query, name) AS similarity
              FROM (SELECT DISTINCT {_MISSPELT} AS query FROM part), (SELECT DISTINCT p_name AS name FROM part))
        WHERE similarity >= 7e-1 QUALIFY rank <= 3""",
)
def similar_names(m: SampleMap) -> DataFrame:
    """Every part name with its third letter lost, matched against the true names."""
    part = m.source("part")
    found = names.suggestions(
        part.select(F.expr(_MISSPELT).alias("query")), part.select(F.col("p_name").alias("name"))
    )
    return found.select("query", "name", "rank", r6("similarity").alias("similarity"))


@query(
    f"""SELECT query, name, round(jaro_winkler_similarity(query, name), 6) AS similarity
        FROM (SELECT DISTINCT {_MISSPELT} AS query FROM part), (SELECT DISTINCT p_name AS name FROM part)
        WHERE jaro_winkler_similarity(query, name) >= 7e-1""",
)
def similar_name_pairs(m: SampleMap) -> DataFrame:
    part = m.source("part")
    found = names.similar_pairs(
        part.select(F.expr(_MISSPELT).alias("query")), part.select(F.col("p_name").alias("name"))
    )
    return found.withColumn("similarity", r6("similarity"))


@query(
    """SELECT id, name FROM bare WHERE regexp_full_match(name, '(AD|V-)[0-9]+')""",
    ("bare",),
)
def developer_systems(m: SampleMap) -> DataFrame:
    return m.bare_systems.where(is_developer_system(F.col("name"))).select("id", "name")


@query(
    """SELECT name, count(*) AS systems, min(id) AS id FROM (SELECT p_partkey AS id, p_name AS name FROM part)
       GROUP BY name HAVING count(*) > 1""",
)
def duplicate_names(m: SampleMap) -> DataFrame:
    part = m.source("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return names.duplicate_names(part)


# --- ships -------------------------------------------------------------------------------------------------

_CHECKED_SHIPS = """WITH RECURSIVE typed AS (
  SELECT trim(ship_name) AS name, TRY_CAST(mass_kg AS DOUBLE) AS base_mass_kg, TRY_CAST(specificheat AS DOUBLE) AS specific_heat,
         TRY_CAST(fuel_capacity_units AS DOUBLE) AS fuel_capacity, TRY_CAST(capacity_m3 AS DOUBLE) AS cargo_capacity
  FROM ship_rows),
checked AS (
  SELECT *, CASE WHEN base_mass_kg IS NULL THEN 'base_mass_kg_unreadable'
                 WHEN base_mass_kg <= 0 THEN 'base_mass_kg_range'
                 WHEN specific_heat <= 0 THEN 'specific_heat_range'
                 WHEN fuel_capacity <= 0 THEN 'fuel_capacity_range'
                 WHEN cargo_capacity <= 0 THEN 'cargo_capacity_range'
                 WHEN count(*) OVER (PARTITION BY lower(name)) > 1 THEN 'name_repeated' END AS problem
  FROM typed)
"""


@query(_CHECKED_SHIPS + "SELECT name, base_mass_kg, round(specific_heat, 6) AS specific_heat, fuel_capacity, cargo_capacity, "
       "problem FROM checked", ("ship_rows",))
def ship_catalogue(m: SampleMap) -> DataFrame:
    return ships.checked_ships(m.sql(SHIP_CATALOGUE)).withColumn("specific_heat", r6("specific_heat"))


@query(_CHECKED_SHIPS + "SELECT name, base_mass_kg, fuel_capacity, cargo_capacity FROM checked WHERE problem IS NULL",
       ("ship_rows",))
def ship_listing(m: SampleMap) -> DataFrame:
    return ships.ship_listing(ships.load_ships(m.sql(SHIP_CATALOGUE)))


@query(
    """SELECT query, name, CAST(row_number() OVER (PARTITION BY query ORDER BY name) AS INTEGER) AS rank
       FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS query FROM part)
       JOIN (SELECT DISTINCT concat(p_name, ' ', p_brand) AS name FROM part) ON contains(lower(name), lower(query))
       QUALIFY rank <= 5""",
)
def ship_suggestions(m: SampleMap) -> DataFrame:
    part = m.source("part")
    catalogue = part.select(F.concat_ws(" ", "p_name", "p_brand").alias("name")).distinct()
    return names.ship_suggestions(part.select(F.explode(F.split("p_name", " ")).alias("query")), catalogue)


@query(
    """SELECT request_id, s.name AS ship_name,
              CASE WHEN s.name IS NULL THEN CASE WHEN ship = 'none' THEN 'none' ELSE 'unknown' END
                   WHEN fuel < 0 THEN 'fuel_load_range'
                   WHEN fuel > fuel_capacity THEN 'fuel_load_over_tank'
                   WHEN cargo < 0 THEN 'cargo_mass_range' ELSE 'ok' END AS ship_status,
              round(CASE WHEN s.name IS NOT NULL THEN coalesce(fuel, fuel_capacity) END, 6) AS loaded_fuel,
              round(CASE WHEN s.name IS NOT NULL THEN cargo END, 6) AS loaded_cargo
       FROM (SELECT event_id AS request_id,
                    CASE event_type WHEN 'click' THEN ' REFLEX ' WHEN 'view' THEN 'forager' WHEN 'error' THEN 'Ghost'
                                    WHEN 'signup' THEN 'none' END AS ship,
                    CASE WHEN value > 20 THEN (value - 30) * 20 END AS fuel, value - 10 AS cargo FROM events) r
       LEFT JOIN ships s ON lower(s.name) = lower(trim(coalesce(ship, 'Reflex')))""",
    ("ships",),
)
def ship_loadouts(m: SampleMap) -> DataFrame:
    asked = m.source("events").select(
        F.col("event_id").alias("request_id"),
        F.expr("""CASE event_type WHEN 'click' THEN ' REFLEX ' WHEN 'view' THEN 'forager' WHEN 'error' THEN 'Ghost'
                  WHEN 'signup' THEN 'none' END""").alias("ship"),
        F.when(F.col("value") > 20, (F.col("value") - 30) * 20).alias("fuel_load"),
        (F.col("value") - 10).alias("cargo_mass"),
    )
    return ships.with_ship(asked, m.ships).select(
        "request_id", "ship_name", "ship_status", r6("loaded_fuel").alias("loaded_fuel"), r6("loaded_cargo").alias("loaded_cargo")
    )


# --- datasets ------------------------------------------------------------------------------------------------

# Kinds of the columns of the map's tables, as their fingerprints see them: i whole numbers, d doubles, s texts.
_KINDS = {
    "Regions": "regionId i, name s",
    "Constellations": "constellationId i, name s, regionId i",
    "SolarSystems": "solarSystemId i, name s, regionId i, constellationId i, centerX d, centerY d, centerZ d, star_temperature d, star_luminosity d",
    "Jumps": "fromSystemId i, toSystemId i",
    "Planets": "planetId i, solarSystemId i, name s, centerX d, centerY d, centerZ d",
    "Moons": "moonId i, planetId i, solarSystemId i, name s, centerX d, centerY d, centerZ d",
}
_RAW = {"Regions": "raw_regions", "Constellations": "raw_constellations", "SolarSystems": "raw_systems", "Jumps": "raw_jumps", "Planets": "raw_planets", "Moons": "raw_moons"}


def _bits_sql(c: str) -> str:
    power = f"floor(log2(abs({c})))"
    exact = f"({power} + CASE WHEN abs({c}) >= pow(2e0, {power} + 1) THEN 1 ELSE 0 END - CASE WHEN abs({c}) < pow(2e0, {power}) THEN 1 ELSE 0 END)"
    return f"""CASE WHEN isnan({c}) THEN 'nan' WHEN {c} IS NOT NULL THEN concat(CASE WHEN CAST({c} AS VARCHAR) LIKE '-%' THEN '-' ELSE '+' END,
      CASE WHEN isinf({c}) THEN 'inf' WHEN {c} = 0 THEN '0'
           ELSE concat(CAST(CAST(greatest({exact}, -1022) AS BIGINT) AS VARCHAR), '.', CAST(CAST(abs({c}) / pow(2e0, greatest({exact}, -1022)) * 4503599627370496e0 AS BIGINT) AS VARCHAR)) END) END"""


def _fingerprint_sql(table: str) -> str:
    fields = []
    for field in _KINDS[table].split(", "):
        column, kind = field.split()
        text = _bits_sql(column) if kind == "d" else f"CAST({column} AS VARCHAR)"
        fields.append(f"coalesce('{kind}' || CAST(strlen({text}) AS VARCHAR) || ':' || ({text}), '~')")
    halves = ", '-', ".join(
        f"CAST(coalesce(sum(CAST(concat('0x', substr(digest, {at}, 16)) AS UBIGINT)), 0) % 18446744073709551616 AS VARCHAR)" for at in (1, 17)
    )
    return f"""SELECT '{table}' AS table_name, count(*) AS row_count, concat({halves}) AS fingerprint, 'tag-1' AS release_tag
        FROM (SELECT md5({" || ".join(fields)}) AS digest FROM {_RAW[table]})"""


@query(" UNION ALL ".join(_fingerprint_sql(t) for t in _KINDS), tuple(_RAW.values()))
def dataset_manifest(m: SampleMap) -> DataFrame:
    return datasets.manifest(m.tables, "tag-1")


def _recorded(m: SampleMap) -> DataFrame:
    """The manifest that an earlier run left of an earlier state of the map, read back from storage.

    Then the jumps were fewer and one coordinate was the next double beside today's; moons were not recorded, a table
    that is gone was, and regions were recorded in the format without fingerprints.
    """
    area = f"{work_area(m.spark)}/manifest-{uuid.uuid4().hex}"
    then = {name: df for name, df in m.tables.items() if name not in ("Moons", "Regions")}
    then["Jumps"] = then["Jumps"].where("fromSystemId % 2 = 0")
    moved = F.when(F.col("solarSystemId") == 30000001, F.col("centerX") * (1 + 2.0**-52)).otherwise(F.col("centerX"))
    then["SolarSystems"] = then["SolarSystems"].withColumn("centerX", moved)
    then["Stations"] = m.tables["Planets"]
    datasets.record_manifest(then, f"{area}/recorded", "tag-1")
    datasets.manifest({"Regions": m.tables["Regions"]}, "tag-1").drop("fingerprint").write.parquet(f"{area}/legacy")
    return datasets.read_manifest(m.spark, f"{area}/recorded").unionByName(datasets.read_manifest(m.spark, f"{area}/legacy"))


@query(
    """SELECT 'Jumps' AS table_name, 'stale' AS status, count(*) FILTER (fromSystemId % 2 = 0) AS expected_rows, count(*) AS actual_rows FROM raw_jumps
       UNION ALL SELECT 'Regions', 'legacy_format', count(*), count(*) FROM raw_regions
       UNION ALL SELECT 'Constellations', 'fresh', count(*), count(*) FROM raw_constellations
       UNION ALL SELECT 'SolarSystems', 'stale', count(*), count(*) FROM raw_systems
       UNION ALL SELECT 'Planets', 'fresh', count(*), count(*) FROM raw_planets
       UNION ALL SELECT 'Moons', 'missing', NULL, count(*) FROM raw_moons
       UNION ALL SELECT 'Stations', 'dataset_missing', count(*), NULL FROM raw_planets""",
    tuple(_RAW.values()),
)
def dataset_freshness(m: SampleMap) -> DataFrame:
    current = datasets.manifest(m.tables, "tag-1")
    return datasets.freshness(current, _recorded(m), strict=True).select("table_name", "status", "expected_rows", "actual_rows")


@query(
    """SELECT 'Jumps' AS table_name, count(*) AS current_rows, count(*) FILTER (fromSystemId % 2 = 0) AS recorded_rows, false AS matches FROM raw_jumps
       UNION ALL SELECT 'Regions', count(*), count(*), true FROM raw_regions
       UNION ALL SELECT 'Constellations', count(*), count(*), true FROM raw_constellations
       UNION ALL SELECT 'SolarSystems', count(*), count(*), true FROM raw_systems
       UNION ALL SELECT 'Planets', count(*), count(*), true FROM raw_planets
       UNION ALL SELECT 'Moons', count(*), NULL, false FROM raw_moons
       UNION ALL SELECT 'Stations', NULL, count(*), false FROM raw_planets""",
    tuple(_RAW.values()),
)
def fixture_counts(m: SampleMap) -> DataFrame:
    """Row counts and releases of all tables against those an earlier step wrote."""
    current = datasets.manifest(m.tables, "tag-1")
    return datasets.verify_counts(current, _recorded(m)).select("table_name", "current_rows", "recorded_rows", "matches")


@query(
    """SELECT 'static' AS layout, 'Regions' AS table_name, regionId AS key, name FROM raw_regions
       UNION ALL SELECT 'static', 'Constellations', constellationId, name FROM raw_constellations
       UNION ALL SELECT 'static', 'SolarSystems', solarSystemId, name FROM raw_systems
       UNION ALL SELECT 'static', 'Planets', planetId, name FROM raw_planets
       UNION ALL SELECT 'static', 'Moons', moonId, name FROM raw_moons
       UNION ALL SELECT 'static', 'Jumps', fromSystemId, CAST(toSystemId AS VARCHAR) FROM raw_jumps""",
    ("raw_regions", "raw_constellations", "raw_systems", "raw_planets", "raw_moons", "raw_jumps"),
)
def inspect_dataset(m: SampleMap) -> DataFrame:
    return datasets.inspect_rows(m.tables)


def _subset_sql() -> str:
    inside = {
        "SolarSystems": "regionId = 2",
        "Jumps": "fromSystemId IN (SELECT id FROM kept) AND toSystemId IN (SELECT id FROM kept)",
        "Regions": "regionId IN (SELECT regionId FROM kept)",
        "Constellations": "constellationId IN (SELECT constellationId FROM kept)",
        "Planets": "solarSystemId IN (SELECT id FROM kept)",
        "Moons": "solarSystemId IN (SELECT id FROM kept)",
    }
    parts = []
    for table, where in inside.items():
        fields = {k: [f.split()[0] for f in _KINDS[table].split(", ") if f.split()[1] == k] for k in "isd"}
        row = {
            "ids": "concat_ws(',', " + ", ".join(fields["i"]) + ")",
            "name": fields["s"][0] if fields["s"] else "CAST(NULL AS VARCHAR)",
            "x": "round(centerX / 1e9, 3)" if "centerX" in fields["d"] else "CAST(NULL AS DOUBLE)",
            "y": "round(centerY / 1e9, 3)" if "centerY" in fields["d"] else "CAST(NULL AS DOUBLE)",
        }
        parts.append(f"SELECT '{table}' AS table_name, " + ", ".join(f"{v} AS {k}" for k, v in row.items()) + f" FROM {_RAW[table]} WHERE {where}")
    return "WITH RECURSIVE kept AS (SELECT solarSystemId AS id, regionId, constellationId FROM raw_systems WHERE regionId = 2) " + " UNION ALL ".join(parts)


@query(_subset_sql(), tuple(_RAW.values()))
def subset_of_region(m: SampleMap) -> DataFrame:
    """All rows of the dataset cut down to one region's systems, written as a dataset of its own and read back."""
    area = f"{work_area(m.spark)}/subset-{uuid.uuid4().hex}"
    keep = m.bare_systems.where("region_id = 2").select("id")
    datasets.write_tables(datasets.subset(m.tables, keep), area)
    parts = []
    for name, df in read_tables(m.spark, area).items():
        ids = [f.split()[0] for f in _KINDS[name].split(", ") if f.endswith(" i")]
        columns = {"name": "string", "centerX": "double", "centerY": "double"}
        held = {c: (F.col(c) if c in df.columns else F.lit(None)).cast(t) for c, t in columns.items()}
        parts.append(
            df.select(
                F.lit(name).alias("table_name"), F.concat_ws(",", *ids).alias("ids"), held["name"].alias("name"),
                F.round(held["centerX"] / 1e9, 3).alias("x"), F.round(held["centerY"] / 1e9, 3).alias("y"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    """SELECT 'systems' AS item, count(*) AS value FROM systems
       UNION ALL SELECT 'indexed', count(x) FROM systems
       UNION ALL SELECT 'with_temperature', count(min_external_temp) FROM systems
       UNION ALL SELECT 'gates', count(*) FROM pairs""",
    ("systems", "pairs"),
)
def dataset_info(m: SampleMap) -> DataFrame:
    return datasets.dataset_info(m.systems, m.pairs)


@query(
    """SELECT CAST(floor(x / 40) AS BIGINT) AS cx, CAST(floor(y / 40) AS BIGINT) AS cy, CAST(floor(z / 40) AS BIGINT) AS cz,
              count(*) AS systems, round(min(min_external_temp), 6) AS coldest
       FROM systems GROUP BY 1, 2, 3""",
    ("systems",),
)
def spatial_layout(m: SampleMap) -> DataFrame:
    """Systems per cell of the stored layout, read back."""
    return _stored_cells(m).groupBy("cx", "cy", "cz").agg(
        F.count(F.lit(1)).alias("systems"), r6(F.min("min_external_temp")).alias("coldest")
    )


def _stored_cells(m: SampleMap) -> DataFrame:
    path = f"{work_area(m.spark)}/cells-{uuid.uuid4().hex}"
    print_of = datasets.fingerprint(m.bare_systems.select("id", "x", "y", "z")).first()["fingerprint"]
    datasets.write_system_cells(datasets.system_cells(m.systems, 40.0), path, fingerprint_text=print_of, release_tag="tag-1", slabs=16)
    return datasets.read_system_cells(m.spark, path)


@query(
    """SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(min_external_temp, 6) AS min_external_temp, 'tag-1' AS release_tag
       FROM systems WHERE floor(x / 40) BETWEEN 3 AND 11 AND floor(y / 40) BETWEEN 2 AND 12 AND floor(z / 40) BETWEEN 0 AND 1""",
    ("systems",),
)
def layout_box(m: SampleMap) -> DataFrame:
    """The systems in a box of cells, found in the stored layout by its statistics."""
    found = datasets.cells_in_box(_stored_cells(m), (3, 2, 0), (11, 12, 1))
    return found.select("id", *[r6(c).alias(c) for c in ("x", "y", "z", "min_external_temp")], "release_tag")


@query(
    """SELECT DISTINCT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(min_external_temp, 6) AS min_external_temp
       FROM systems WHERE id IN (SELECT 30000000 + user_id FROM events)""",
    ("systems",),
)
def layout_lookup(m: SampleMap) -> DataFrame:
    ids = m.source("events").select((F.col("user_id") + 30_000_000).alias("id")).distinct()
    found = datasets.lookup(ids, _stored_cells(m))
    return found.select("id", *[r6(c).alias(c) for c in ("x", "y", "z", "min_external_temp")])
