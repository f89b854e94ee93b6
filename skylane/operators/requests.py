"""Route and scout request tables: defaults, validation, endpoint checks, advice, echo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylane.functions.ship_physics import DEFAULT_CALIBRATION, DEFAULT_FUEL_QUALITY, HEAT_CRITICAL

ALGORITHMS = ("bfs", "dijkstra", "a-star")
OBJECTIVES = ("distance", "fuel")
DEFAULT_SCOUT_LIMIT = 10

# Column -> type and default of a route request; a column the caller omits takes the default.
ROUTE_REQUEST = {
    "request_id": ("long", None),
    "from_name": ("string", None),
    "to_name": ("string", None),
    "algorithm": ("string", "a-star"),
    "optimization": ("string", "fuel"),
    "max_jump": ("double", None),
    "avoid": ("array<string>", None),
    "avoid_gates": ("boolean", False),
    "max_temperature": ("double", None),
    "avoid_critical_state": ("boolean", True),
    "ship": ("string", None),
    "fuel_load": ("double", None),
    "cargo_mass": ("double", None),
    "fuel_quality": ("double", DEFAULT_FUEL_QUALITY),
    "heat_calibration": ("double", DEFAULT_CALIBRATION),
    "dynamic_mass": ("boolean", False),
    "max_spatial_neighbors": ("int", None),
}

SCOUT_REQUEST = {
    "request_id": ("long", None),
    "system": ("string", None),
    "limit": ("int", DEFAULT_SCOUT_LIMIT),
    "radius": ("double", None),
    "max_temperature": ("double", None),
    "avoid": ("array<string>", None),
    "avoid_gates": ("boolean", False),
    "include_dev": ("boolean", False),
    "avoid_critical_state": ("boolean", False),
    "no_avoid_critical_state": ("boolean", False),
}


def _with_defaults(requests: DataFrame, columns: dict) -> DataFrame:
    out = []
    for name, (kind, default) in columns.items():
        value = F.col(name).cast(kind) if name in requests.columns else F.lit(None).cast(kind)
        out.append((value if default is None else F.coalesce(value, F.lit(default).cast(kind))).alias(name))
    extra = [c for c in requests.columns if c not in columns]
    return requests.select(*out, *extra)


def route_requests(requests: DataFrame) -> DataFrame:
    """Requests with every column present; lists become empty rather than null."""
    return _with_defaults(requests, ROUTE_REQUEST).withColumn(
        "avoid", F.coalesce("avoid", F.array().cast(T.ArrayType(T.StringType())))
    )


def scout_requests(requests: DataFrame) -> DataFrame:
    return _with_defaults(requests, SCOUT_REQUEST).withColumn(
        "avoid", F.coalesce("avoid", F.array().cast(T.ArrayType(T.StringType())))
    )


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def route_problem(reject_same_ends: bool = False) -> Column:
    """The code of the first thing wrong with a route request, or null.

    ``reject_same_ends`` adds the stricter rule of the assistant-facing surface.
    """
    problem = (
        F.when(_blank(F.col("from_name")), "from_missing")
        .when(_blank(F.col("to_name")), "to_missing")
        .when(~F.col("algorithm").isin(*ALGORITHMS), "algorithm_unknown")
        .when(~F.col("optimization").isin(*OBJECTIVES), "optimization_unknown")
        .when(F.col("max_jump") <= 0, "max_jump_range")
        .when(F.col("max_temperature") <= 0, "max_temperature_range")
        .when(F.col("ship").isNotNull() & _blank(F.col("ship")), "ship_blank")
        .when(~F.col("fuel_quality").between(1.0, 100.0), "fuel_quality_range")
        .when(F.col("cargo_mass") < 0, "cargo_mass_range")
        .when(F.col("fuel_load") < 0, "fuel_load_range")
        .when(F.col("max_spatial_neighbors") < 0, "max_spatial_neighbors_range")
    )
    if reject_same_ends:
        problem = problem.when(F.col("from_name") == F.col("to_name"), "same_ends")
    return problem


def scout_problem(radius_required: bool = False) -> Column:
    """The code of the first thing wrong with a scout request, or null."""
    problem = (
        F.when(_blank(F.col("system")), "system_missing")
        .when(F.col("limit") < 1, "limit_range")
        .when(F.col("radius") <= 0, "radius_range")
        .when(F.col("max_temperature") <= 0, "max_temperature_range")
    )
    return problem.when(F.col("radius").isNull(), "radius_missing") if radius_required else problem


def checked(requests: DataFrame, problem: Column) -> DataFrame:
    """Requests with a ``problem`` column; split on it for the valid and the rejected ones."""
    return requests.withColumn("problem", problem)


def effective_scout_temperature() -> Column:
    """Temperature cap in scouting: critical when avoidance is on (an explicit off wins), else the given one."""
    on = F.col("avoid_critical_state") & ~F.col("no_avoid_critical_state")
    return F.when(on, F.lit(HEAT_CRITICAL)).otherwise(F.col("max_temperature"))


def endpoint_blocked(start_temperature: Column, goal_temperature: Column, ends_avoided: Column) -> Column:
    """True when an end is avoided or its star is hotter than the limit; unknown stars pass."""
    limit = F.col("max_temperature")
    too_hot = F.coalesce(start_temperature > limit, F.lit(False)) | F.coalesce(goal_temperature > limit, F.lit(False))
    return ends_avoided | too_hot


def failure_advice(ship: str = "ship") -> Column:
    """The request's own columns that could be relaxed, joined by commas; ``ship`` names the column of the ship in use.

    ``ship`` itself is listed where a ship would let the heat of jumps be judged, ``algorithm`` where
    nothing else limits the request.
    """
    relaxable = F.concat_ws(
        ",",
        F.when(F.col("max_jump").isNotNull(), "max_jump"),
        F.when(F.col("avoid_gates"), "avoid_gates"),
        F.when(F.col("max_temperature").isNotNull(), "max_temperature"),
        F.when(F.col("avoid_critical_state"), "avoid_critical_state"),
        F.when(F.col("avoid_critical_state") & F.col(ship).isNull(), "ship"),
    )
    return F.when(relaxable != "", relaxable).otherwise("algorithm")


def parameters_echo() -> Column:
    """The request's parameters as reported beside its result."""
    return F.struct(
        "algorithm",
        "optimization",
        "fuel_quality",
        F.col("ship").alias("ship_name"),
        "avoid_critical_state",
        "max_spatial_neighbors",
        "avoid_gates",
        "max_jump",
    )
