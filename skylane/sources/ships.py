"""Ship catalogues: CSV with varying headers, validation, lookup and listing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylane.functions.geometry import is_finite
from skylane.functions.text import folded

# Accepted headers for each field, after normalisation, in order of preference.
HEADER_SYNONYMS = {
    "name": ("name", "shipname", "ship_name", "ship"),
    "base_mass_kg": ("base_mass_kg", "mass_kg", "mass", "masskg", "masskg_kg"),
    "specific_heat": ("specific_heat", "specificheat_c", "specificheat"),
    "fuel_capacity": ("fuel_capacity", "fuel_capacity_units", "fuelcapacity_units", "fuelcapacity"),
    "cargo_capacity": ("cargo_capacity", "capacity_m3", "capacity"),
}
NUMERIC_FIELDS = ("base_mass_kg", "specific_heat", "fuel_capacity", "cargo_capacity")
SHIP_SCHEMA = "name string, base_mass_kg double, specific_heat double, fuel_capacity double, cargo_capacity double"
DEFAULT_SHIP = "Reflex"


class MissingShipColumns(ValueError):
    """A catalogue lacks a required column."""


def normal_header(header: str) -> str:
    return re.sub(r"[^a-z0-9_]", "", header.lower())


def match_headers(headers: list[str]) -> dict[str, str]:
    """Canonical field -> header as written; raises when a field has no header."""
    written_as: dict[str, str] = {}
    for header in headers:
        written_as.setdefault(normal_header(header), header)
    found = {
        field: next((written_as[s] for s in synonyms if s in written_as), None)
        for field, synonyms in HEADER_SYNONYMS.items()
    }
    missing = [field for field, header in found.items() if header is None]
    if missing:
        raise MissingShipColumns(
            f"no header for {missing} among {headers}"
        )
    return found


def read_ship_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a catalogue file with text values, as written."""
    return spark.read.csv(
        path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True
    )


def checked_ships(raw: DataFrame) -> DataFrame:
    """Typed rows with ``problem``: null for a usable ship, else why it is rejected.

    A name that repeats, ignoring case and blanks, rejects all rows that bear it.
    """
    headers = match_headers(raw.columns)
    typed = raw.select(
        F.trim(F.col(f"`{headers['name']}`").cast("string")).alias("name"),
        *[F.trim(F.col(f"`{headers[f]}`").cast("string")).alias(f"{f}_text") for f in NUMERIC_FIELDS],
    ).withColumns({f: F.col(f"{f}_text").try_cast("double") for f in NUMERIC_FIELDS})
    problem = F.when(F.coalesce(F.col("name"), F.lit("")) == "", "name_blank")
    for field in NUMERIC_FIELDS:
        problem = problem.when(F.col(field).isNull(), f"{field}_unreadable").when(
            ~(is_finite(F.col(field)) & (F.col(field) > 0)), f"{field}_range"
        )
    counts = typed.groupBy(folded(F.col("name")).alias("key")).agg(F.count(F.lit(1)).alias("bearers"))
    problem = problem.when(F.col("bearers") > 1, "name_repeated")
    return (
        typed.join(counts, folded(F.col("name")).eqNullSafe(F.col("key")), "left")
        .select("name", *NUMERIC_FIELDS, problem.alias("problem"))
    )


def load_ships(raw: DataFrame) -> DataFrame:
    """The usable ships of a catalogue."""
    return checked_ships(raw).where("problem is null").drop("problem")


def rejected_ships(raw: DataFrame) -> DataFrame:
    return checked_ships(raw).where("problem is not null")


def ship_listing(ships: DataFrame) -> DataFrame:
    """Catalogue in name order."""
    return ships.select("name", "base_mass_kg", "fuel_capacity", "cargo_capacity").orderBy("name")


def with_ship(requests: DataFrame, ships: DataFrame, default: str | None = DEFAULT_SHIP) -> DataFrame:
    """Attach each request's ship, loadout and a ``ship_status``.

    Names match trimmed and without regard to case. ``none`` asks for no ship; an omitted name takes
    ``default`` where that ship exists. ``ship_status`` is ok, none, unknown or a loadout problem.
    Fuel defaults to a full tank, cargo to none; fuel must fit the tank and neither be negative.
    """
    wanted = F.when(F.col("ship").isNull(), F.lit(default)).otherwise(F.col("ship"))
    wanted = F.when(folded(wanted) != "none", folded(wanted))
    catalogue = ships.select(
        folded(F.col("name")).alias("ship_key"),
        F.col("name").alias("ship_name"),
        *[F.col(f).alias(f"ship_{f}") for f in NUMERIC_FIELDS],
    )
    joined = requests.withColumn("wanted_ship", wanted).join(
        catalogue, F.col("wanted_ship") == F.col("ship_key"), "left"
    )
    found = F.col("ship_name").isNotNull()
    fuel = F.coalesce(F.col("fuel_load"), F.col("ship_fuel_capacity"))
    cargo = F.coalesce(F.col("cargo_mass"), F.lit(0.0))
    problem = (
        F.when(~is_finite(fuel) | (fuel < 0), "fuel_load_range")
        .when(fuel > F.col("ship_fuel_capacity"), "fuel_load_over_tank")
        .when(~is_finite(cargo) | (cargo < 0), "cargo_mass_range")
    )
    status = (
        F.when(found & problem.isNotNull(), problem)
        .when(found, "ok")
        .when(F.col("wanted_ship").isNull() | F.col("ship").isNull(), "none")
        .otherwise("unknown")
    )
    return (
        joined.withColumn("ship_status", status)
        .withColumn("loaded_fuel", F.when(found, fuel))
        .withColumn("loaded_cargo", F.when(found, cargo))
        .drop("wanted_ship", "ship_key")
    )
