"""Route corpora: CSV rows whose path column is a JSON array of systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH_TYPE = "array<struct<Id:bigint,Name:string>>"
CORPUS_SCHEMA = (
    "routeId long, startSolarSystemId long, endSolarSystemId long, avoidGates string, maxLightyears double, "
    "discoveredPath string"
)


def read_corpus_csv(spark: SparkSession, path: str) -> DataFrame:
    """Corpus rows as written; the JSON column doubles its quotes as CSV asks."""
    return spark.read.csv(path, header=True, schema=CORPUS_SCHEMA, quote='"', escape='"')


def corpus_routes(raw: DataFrame) -> DataFrame:
    """One row per route with typed columns and the parsed path."""
    return raw.select(
        F.col("routeId").cast("long").alias("route_id"),
        F.col("startSolarSystemId").cast("long").alias("start_id"),
        F.col("endSolarSystemId").cast("long").alias("end_id"),
        (F.col("avoidGates") == "true").alias("avoid_gates"),
        F.col("maxLightyears").cast("double").alias("max_ly"),
        F.from_json("discoveredPath", PATH_TYPE).alias("path"),
    )


def corpus_steps(routes: DataFrame) -> DataFrame:
    """``route_id, pos, system_id, name`` of every step."""
    return routes.select(
        "route_id", "avoid_gates", "max_ly", F.posexplode("path").alias("pos", "step")
    ).select(
        "route_id", "pos", F.col("step.Id").alias("system_id"), F.col("step.Name").alias("name"), "avoid_gates", "max_ly"
    )
