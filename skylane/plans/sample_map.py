"""A star map, requests and logs derived from the TPC-H-like sample tables.

The derivation is SQL that Spark and other engines read alike, so the same text feeds the checks. Every
row of the source tables takes part: customers become systems, orders jumps and planets, line items
moons and route steps, suppliers route requests, events scout requests and log rows, parts ships.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylane.operators.celestial import with_celestials
from skylane.operators.edges import gate_pairs
from skylane.sources.corpus import corpus_routes, corpus_steps
from skylane.sources.ships import SHIP_SCHEMA
from skylane.sources.starmap import detect_layout, load_celestials, load_jumps, load_systems

REGIONS = "SELECT CAST(r_regionkey AS BIGINT) AS regionId, r_name AS name FROM {region}"

CONSTELLATIONS = """
SELECT CAST(n_nationkey AS BIGINT) AS constellationId, n_name AS name, CAST(n_regionkey AS BIGINT) AS regionId
FROM {nation}"""

SOLAR_SYSTEMS = """
SELECT 30000000 + c_custkey AS solarSystemId,
       CASE WHEN c_custkey % 50 = 3 THEN concat('AD', c_custkey)
            WHEN c_custkey % 50 = 7 THEN concat('V-', c_custkey) ELSE c_name END AS name,
       CAST(n_regionkey AS BIGINT) AS regionId,
       CAST(c_nationkey AS BIGINT) AS constellationId,
       CAST((c_custkey * 7919) % 1009 AS DOUBLE) * 9.4607304725808e15 AS centerX,
       CAST((c_custkey * 104729) % 997 AS DOUBLE) * 9.4607304725808e15 AS centerY,
       CAST((c_custkey * 1299709) % 101 AS DOUBLE) * 9.4607304725808e15 AS centerZ,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(2000 + c_custkey % 9000 AS DOUBLE) END AS star_temperature,
       c_acctbal * 1e22 AS star_luminosity
FROM {customer} LEFT JOIN {nation} ON n_nationkey = c_nationkey"""

JUMPS = """
SELECT 30000000 + o_custkey AS fromSystemId,
       30000000 + ((o_orderkey * 17 + o_custkey * 7) % ((SELECT count(*) FROM {customer}) + 5)) AS toSystemId
FROM {orders}"""

PLANETS = """
SELECT o_orderkey AS planetId, 30000000 + o_custkey AS solarSystemId, concat('Planet ', o_orderkey) AS name,
       CASE WHEN o_orderkey % 211 = 5 THEN NULL ELSE o_totalprice * 1e5 END AS centerX,
       CAST(0 AS DOUBLE) AS centerY, CAST(0 AS DOUBLE) AS centerZ
FROM {orders}"""

MOONS = """
SELECT l_orderkey * 10 + l_linenumber AS moonId, l_orderkey AS planetId, 30000000 + o_custkey AS solarSystemId,
       concat('Moon ', l_orderkey, '-', l_linenumber) AS name,
       CAST(0 AS DOUBLE) AS centerX, l_extendedprice * 1e5 AS centerY, CAST(0 AS DOUBLE) AS centerZ
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey"""

ROUTE_REQUESTS = """
SELECT s_suppkey AS request_id,
       concat('Customer#', lpad(CAST((s_suppkey * 37 + 11) % (SELECT count(*) FROM {customer}) AS VARCHAR(20)), 9, '0'))
         AS from_name,
       concat('Customer#', lpad(CAST((s_suppkey * 101 + 77) % (SELECT count(*) FROM {customer}) AS VARCHAR(20)), 9, '0'))
         AS to_name,
       CASE s_nationkey % 3 WHEN 0 THEN 'bfs' WHEN 1 THEN 'dijkstra' ELSE 'a-star' END AS algorithm,
       CASE WHEN s_nationkey % 2 = 0 THEN 'distance' ELSE 'fuel' END AS optimization,
       CASE WHEN s_suppkey % 5 = 0 THEN CAST(60 AS DOUBLE) END AS max_jump,
       s_suppkey % 6 = 0 AS avoid_gates,
       CASE WHEN s_suppkey % 8 = 3 THEN CAST(9000 AS DOUBLE) END AS max_temperature,
       s_suppkey % 9 <> 4 AS avoid_critical_state,
       CASE s_suppkey % 4 WHEN 0 THEN 'Reflex' WHEN 1 THEN ' forager ' WHEN 2 THEN 'WARDEN' END AS ship,
       CASE WHEN s_suppkey % 3 = 1
            THEN concat('Customer#', lpad(CAST((s_suppkey * 53 + 5) % (SELECT count(*) FROM {customer}) AS VARCHAR(20)), 9, '0'))
       END AS avoid_name,
       CAST(5 + s_suppkey % 20 AS DOUBLE) AS fuel_quality,
       s_suppkey % 2 = 1 AS dynamic_mass,
       8 AS max_spatial_neighbors
FROM {supplier}"""

SCOUT_REQUESTS = """
SELECT event_id AS request_id,
       CASE WHEN event_type = 'error' THEN concat('Customer#', user_id)
            ELSE concat('Customer#', lpad(CAST(user_id AS VARCHAR(20)), 9, '0')) END AS system,
       CAST(3 + event_id % 4 AS INT) AS "limit",
       CASE WHEN event_type = 'view' THEN CAST(90 AS DOUBLE) END AS radius,
       CASE WHEN event_type = 'purchase' THEN CAST(40 AS DOUBLE) END AS max_temperature,
       event_type = 'click' AS include_dev
FROM {events}"""

REQUEST_LOG = """
SELECT event_id AS request_id, ts,
       CASE event_type WHEN 'click' THEN 'scout-gates' WHEN 'view' THEN 'scout-range' ELSE 'route' END AS service,
       CASE event_type WHEN 'click' THEN '/api/v1/scout/gates' WHEN 'view' THEN '/api/v1/scout/range'
                       ELSE '/api/v1/route' END AS path,
       'POST' AS method,
       CASE WHEN event_type = 'error' AND value >= 60 THEN 500 WHEN event_type = 'error' THEN 404
            WHEN event_type = 'signup' AND value >= 100 THEN 302 ELSE 200 END AS status,
       value * 10.0e0 AS latency_ms,
       CASE user_id % 3 WHEN 0 THEN 'bfs' WHEN 1 THEN 'dijkstra' ELSE 'a-star' END AS algorithm
FROM {events}"""

# Steps of a route corpus: every order is a route through one system per line item.
CORPUS_STEPS = """
SELECT l_orderkey AS route_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS pos,
       30000000 + (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM {customer}) AS system_id
FROM {lineitem}"""

SHIP_CATALOGUE = """
SELECT concat('  ', p_brand, ' ', CASE WHEN p_partkey % 40 = 9 THEN 'Twin' ELSE CAST(p_partkey AS VARCHAR(20)) END) AS ship_name,
       CASE WHEN p_size = 13 THEN 'n/a' ELSE CAST(CAST(p_size AS BIGINT) * 100000 AS VARCHAR(20)) END AS mass_kg,
       CAST(CAST(p_size AS DOUBLE) / 25 AS VARCHAR(20)) AS specificheat,
       CASE WHEN p_size = 17 THEN '-5' ELSE CAST(CAST(p_size AS BIGINT) * 40 AS VARCHAR(20)) END AS fuel_capacity_units,
       CAST(CAST(p_size AS BIGINT) * 1000 AS VARCHAR(20)) AS capacity_m3
FROM {part}"""

# The ships of the reference fixture.
SHIPS = [
    ("Reflex", 10_000_000.0, 0.9, 1750.0, 800_000.0),
    ("Forager", 15_000_000.0, 0.85, 2200.0, 1_200_000.0),
    ("Warden", 8_000_000.0, 1.1, 1400.0, 500_000.0),
]

SOURCE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@dataclass
class SampleMap:
    """Lazy DataFrames of the derived map, over one scale-factor folder."""

    spark: SparkSession
    folder: str

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = {name: self.source(name) for name in SOURCE_TABLES if "{" + name + "}" in text}
        if "orders" in used:
            # Line items meet them by key; two columns of them look small by their file and were built on the driver.
            used["orders"] = used["orders"].hint("merge")
        return self.spark.sql(text.replace('"limit"', "`limit`"), **used)

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        texts = {
            "Regions": REGIONS,
            "Constellations": CONSTELLATIONS,
            "SolarSystems": SOLAR_SYSTEMS,
            "Jumps": JUMPS,
            "Planets": PLANETS,
            "Moons": MOONS,
        }
        return {name: self.sql(text) for name, text in texts.items()}

    @cached_property
    def legacy_tables(self) -> dict[str, DataFrame]:
        systems, jumps = self.tables["SolarSystems"], self.tables["Jumps"]
        return {
            "mapSolarSystems": systems.select(
                F.col("solarSystemId").alias("solarSystemID"), F.col("name").alias("solarSystemName")
            ),
            "mapSolarSystemJumps": jumps.select(
                F.col("fromSystemId").alias("fromSolarSystemID"), F.col("toSystemId").alias("toSolarSystemID")
            ),
        }

    @cached_property
    def bare_systems(self) -> DataFrame:
        return load_systems(self.tables, detect_layout(self.tables))

    @cached_property
    def celestials(self) -> DataFrame:
        return load_celestials(self.tables)

    @cached_property
    def systems(self) -> DataFrame:
        return with_celestials(self.bare_systems, self.celestials)

    @cached_property
    def jumps(self) -> DataFrame:
        return load_jumps(self.tables, detect_layout(self.tables))

    @cached_property
    def pairs(self) -> DataFrame:
        return gate_pairs(self.jumps, self.bare_systems)

    @cached_property
    def ships(self) -> DataFrame:
        return self.spark.createDataFrame(SHIPS, SHIP_SCHEMA)

    @cached_property
    def route_requests(self) -> DataFrame:
        asked = self.sql(ROUTE_REQUESTS)
        return asked.withColumn("avoid", F.array_compact(F.array("avoid_name"))).drop("avoid_name")

    @cached_property
    def scout_requests(self) -> DataFrame:
        return self.sql(SCOUT_REQUESTS)

    @cached_property
    def request_log(self) -> DataFrame:
        return self.sql(REQUEST_LOG)

    @cached_property
    def raw_corpus(self) -> DataFrame:
        """Corpus rows in their file form, the path as JSON text."""
        steps = self.sql(CORPUS_STEPS)
        names = self.bare_systems.select(F.col("id").alias("system_id"), "name")
        hop = F.struct("pos", F.col("system_id").alias("Id"), F.col("name").alias("Name"))
        path = F.array_sort(F.collect_list(hop))
        # Either side may be far larger than its file looks, so neither is broadcast.
        routes = steps.join(names.hint("merge"), "system_id").groupBy("route_id").agg(path.alias("path"))
        return routes.select(
            F.col("route_id").alias("routeId"),
            F.col("path")[0]["Id"].alias("startSolarSystemId"),
            F.element_at("path", -1)["Id"].alias("endSolarSystemId"),
            F.when(F.col("route_id") % 3 == 0, "true").otherwise("false").alias("avoidGates"),
            (F.col("route_id") % 100).cast("double").alias("maxLightyears"),
            F.to_json(F.transform("path", lambda h: F.struct(h["Id"].alias("Id"), h["Name"].alias("Name")))).alias(
                "discoveredPath"
            ),
        )

    @cached_property
    def corpus_routes(self) -> DataFrame:
        return corpus_routes(self.raw_corpus)

    @cached_property
    def corpus_steps(self) -> DataFrame:
        return corpus_steps(self.corpus_routes)

    @cached_property
    def corpus_walks(self) -> DataFrame:
        """The corpus in the shape of planned routes: ``request_id, step, system_id``."""
        return self.sql(CORPUS_STEPS).select(
            F.col("route_id").alias("request_id"), F.col("pos").alias("step"), "system_id"
        )
