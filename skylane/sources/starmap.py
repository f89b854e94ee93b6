"""Map tables: layout detection, system and gate scans, celestial scans.

Input is a dictionary of DataFrames keyed by table name (Parquet, CSV or any other Spark source).
Table and column names match without regard to case. Optional parts that are absent become nulls.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylane.functions.geometry import light_years, only_if_placed

# Table and column names of the two known layouts.
STATIC_SYSTEMS, STATIC_JUMPS = "SolarSystems", "Jumps"
LEGACY_SYSTEMS, LEGACY_JUMPS = "mapSolarSystems", "mapSolarSystemJumps"
MAP_TABLES = ("Regions", "Constellations", "SolarSystems", "Jumps", "Planets", "Moons")
POSITION_COLUMNS = (("centerX", "centerY", "centerZ"), ("x", "y", "z"))


class UnsupportedSchema(ValueError):
    """Neither known layout matches the tables given."""


@dataclass(frozen=True)
class Layout:
    """Where each part of a map is found; ``None`` marks an optional part that is absent."""

    name: str
    systems: str
    jumps: str
    system_id: str
    system_name: str
    jump_from: str
    jump_to: str
    position: tuple[str, str, str] | None = None
    constellations: str | None = None
    regions: str | None = None
    security: str | None = None


def read_tables(spark: SparkSession, folder: str, fmt: str = "parquet", names=MAP_TABLES, **options) -> dict[str, DataFrame]:
    """Read the map tables that exist under ``folder``, one sub-folder or file per table."""
    found = {}
    for name in names:
        try:
            found[name] = spark.read.format(fmt).options(**options).load(f"{folder}/{name}")
        except Exception as missing:  # an absent optional table is not an error
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    return found


def find_table(tables: Mapping[str, DataFrame], name: str) -> DataFrame | None:
    for key, df in tables.items():
        if key.lower() == name.lower():
            return df
    return None


def _has(df: DataFrame | None, *columns: str) -> bool:
    if df is None:
        return False
    present = {c.lower() for c in df.columns}
    return all(c.lower() in present for c in columns)


def detect_layout(tables: Mapping[str, DataFrame]) -> Layout:
    """Pick the current layout, else the legacy one, else raise ``UnsupportedSchema``."""
    systems = find_table(tables, STATIC_SYSTEMS)
    jumps = find_table(tables, STATIC_JUMPS)
    if _has(systems, "solarSystemId", "name") and _has(jumps, "fromSystemId", "toSystemId"):
        return Layout(
            name="static",
            systems=STATIC_SYSTEMS,
            jumps=STATIC_JUMPS,
            system_id="solarSystemId",
            system_name="name",
            jump_from="fromSystemId",
            jump_to="toSystemId",
            position=next((p for p in POSITION_COLUMNS if _has(systems, *p)), None),
            constellations="Constellations"
            if _has(systems, "constellationId")
            and _has(find_table(tables, "Constellations"), "constellationId", "name")
            else None,
            regions="Regions"
            if _has(systems, "regionId") and _has(find_table(tables, "Regions"), "regionId", "name")
            else None,
            security="security" if _has(systems, "security") else None,
        )
    if _has(find_table(tables, LEGACY_SYSTEMS), "solarSystemID", "solarSystemName") and _has(
        find_table(tables, LEGACY_JUMPS), "fromSolarSystemID", "toSolarSystemID"
    ):
        return Layout(
            name="legacy",
            systems=LEGACY_SYSTEMS,
            jumps=LEGACY_JUMPS,
            system_id="solarSystemID",
            system_name="solarSystemName",
            jump_from="fromSolarSystemID",
            jump_to="toSolarSystemID",
        )
    raise UnsupportedSchema("no system and jump tables of a known layout among: " + ", ".join(sorted(tables)))


def _optional(df: DataFrame, column: str, kind: str):
    return F.col(f"s.{column}").cast(kind) if _has(df, column) else F.lit(None).cast(kind)


def load_systems(tables: Mapping[str, DataFrame], layout: Layout | None = None) -> DataFrame:
    """One row per system with names of its constellation and region and its position in light-years.

    A position with a null, NaN or infinite coordinate is dropped as a whole while the row stays.
    """
    layout = layout or detect_layout(tables)
    raw = find_table(tables, layout.systems)
    out = raw.alias("s")
    constellation_name = region_name = F.lit(None).cast("string")
    if layout.constellations:
        side = find_table(tables, layout.constellations)
        side = side.select(F.col("constellationId").alias("c_id"), F.col("name").alias("c_name"))
        out = out.join(side, F.col("s.constellationId") == F.col("c_id"), "left")
        constellation_name = F.col("c_name")
    if layout.regions:
        side = find_table(tables, layout.regions)
        side = side.select(F.col("regionId").alias("r_id"), F.col("name").alias("r_name"))
        out = out.join(side, F.col("s.regionId") == F.col("r_id"), "left")
        region_name = F.col("r_name")
    if layout.position:
        metres = [F.col(f"s.{c}").cast("double") for c in layout.position]
        position = [only_if_placed(light_years(m), *metres) for m in metres]
    else:
        position = [F.lit(None).cast("double")] * 3
    static = layout.name == "static"
    optional = (lambda c, k: _optional(raw, c, k)) if static else (lambda c, k: F.lit(None).cast(k))
    return out.select(
        F.col(f"s.{layout.system_id}").cast("long").alias("id"),
        F.col(f"s.{layout.system_name}").cast("string").alias("name"),
        optional("constellationId", "long").alias("constellation_id"),
        constellation_name.alias("constellation_name"),
        optional("regionId", "long").alias("region_id"),
        region_name.alias("region_name"),
        (_optional(raw, layout.security, "double") if layout.security else F.lit(None).cast("double")).alias(
            "security_status"
        ),
        optional("star_temperature", "double").alias("star_temperature"),
        optional("star_luminosity", "double").alias("star_luminosity"),
        *[p.alias(axis) for p, axis in zip(position, "xyz")],
    )


def load_jumps(tables: Mapping[str, DataFrame], layout: Layout | None = None) -> DataFrame:
    """Gate endpoints as stored: ``src, dst``."""
    layout = layout or detect_layout(tables)
    return find_table(tables, layout.jumps).select(
        F.col(layout.jump_from).cast("long").alias("src"), F.col(layout.jump_to).cast("long").alias("dst")
    )


def _bodies(df: DataFrame, kind: str) -> DataFrame:
    return df.select(
        F.col("solarSystemId").cast("long").alias("system_id"),
        F.lit(kind).alias("kind"),
        F.col("centerX").cast("double").alias("x_m"),
        F.col("centerY").cast("double").alias("y_m"),
        F.col("centerZ").cast("double").alias("z_m"),
    )


def load_celestials(tables: Mapping[str, DataFrame]) -> DataFrame | None:
    """Planets and moons in one table, all rows; ``None`` when the map has neither."""
    parts = [
        _bodies(df, kind)
        for name, kind in (("Planets", "planet"), ("Moons", "moon"))
        if (df := find_table(tables, name)) is not None
    ]
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def placed_celestials(celestials: DataFrame) -> DataFrame:
    """Bodies with a full position."""
    return celestials.dropna(subset=["x_m", "y_m", "z_m"])
