"""Fuel and heat arithmetic as column expressions.

Invalid inputs give null, never an exception, so one bad row cannot fail a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.functions.geometry import is_finite

# Ship constants and heat thresholds (Kelvin).
FUEL_UNIT_MASS_KG = 1.0
HEAT_NOMINAL = 30.0
HEAT_OVERHEATED = 90.0
HEAT_CRITICAL = 150.0
BASE_COOLING_POWER = 1e6
COOLING_EPSILON = 0.01
DEFAULT_CALIBRATION = 1e-7
DEFAULT_FUEL_QUALITY = 10.0


def bound(values: dict[str, Column], use: Callable[[Column], Column]) -> Column:
    """``use`` of a struct of ``values``, each worked out once however often it is used.

    A column expression that names another several times repeats it each time, and repeats of repeats multiply. An
    element of an array is worked out once.
    """
    return F.get(F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), use), F.lit(0))


def _positive(value: Column) -> Column:
    return is_finite(value) & (value > 0)


def total_mass(base_mass: Column, fuel_load: Column, cargo_mass: Column) -> Column:
    """Hull, fuel and cargo together, in kilograms."""
    return base_mass + fuel_load * F.lit(FUEL_UNIT_MASS_KG) + cargo_mass


def quality_share(quality: Column) -> Column:
    """Share of full price that a fuel quality costs; null out of 1..100."""
    return F.when(quality.between(1.0, 100.0), quality / 100.0)


def jump_length(distance: Column) -> Column:
    """Length of a jump that has a price; null for a zero-length one."""
    return F.when(_positive(distance), distance)


def fuel_rate(mass: Column, quality: Column) -> Column:
    """Fuel units per light-year; null when the mass or the quality (1..100) is out of range."""
    return F.when(_positive(mass), mass / 100_000.0 * quality_share(quality))


def jump_fuel_of(mass: Column, share: Column, length: Column) -> Column:
    """Fuel for one jump, given ``quality_share`` and ``jump_length``; a fold works those out ahead."""
    return F.when(_positive(mass), mass / 100_000.0 * share) * length


def jump_fuel(mass: Column, quality: Column, distance: Column) -> Column:
    """Fuel for one jump. A higher quality costs more, and a zero-length jump has no price."""
    return jump_fuel_of(mass, quality_share(quality), jump_length(distance))


def maximum_distance(fuel: Column, mass: Column, quality: Column) -> Column:
    """Reach of a tank. Uses quality as a plain factor, so it is not the inverse of ``jump_fuel``."""
    return F.when(
        is_finite(fuel) & (fuel >= 0) & _positive(mass) & is_finite(quality),
        fuel * (quality / 100.0) * 100_000.0 / mass,
    )


def jump_heat_energy(mass: Column, distance: Column, hull_mass: Column, calibration: Column) -> Column:
    """Energy-like heat of one jump; zero for a zero-length one."""
    usable = (
        is_finite(distance) & (distance >= 0)
        & _positive(mass) & _positive(hull_mass) & _positive(calibration)
    )
    energy = 3.0 * mass * distance / (calibration * hull_mass)
    return F.when(usable & is_finite(energy), energy)


def heat_per_light_year(hull_mass: Column, specific_heat: Column, calibration: Column) -> Column:
    """Temperature rise per light-year. The total mass cancels out of energy / (mass x heat)."""
    return F.when(
        _positive(hull_mass) & _positive(specific_heat) & _positive(calibration),
        3.0 / (calibration * hull_mass * specific_heat),
    )


def zone_factor(ambient: Column) -> Column:
    """How well a place cools: 1 in the cold, down to 0.05; 0.1 where the ambient is unknown."""
    return (
        F.when(~is_finite(ambient), 0.1)
        .when(ambient <= 30.0, 1.0)
        .when(ambient <= 100.0, 0.7)
        .when(ambient <= 300.0, 0.4)
        .when(ambient <= 1000.0, 0.2)
        .otherwise(0.05)
    )


def cooling_constant(mass: Column, specific_heat: Column, ambient: Column) -> Column:
    """Newton cooling constant (1/s); 0 when mass or specific heat is unusable."""
    return F.when(
        _positive(mass) & _positive(specific_heat),
        F.lit(BASE_COOLING_POWER) * zone_factor(ambient) / (mass * specific_heat),
    ).otherwise(F.lit(0.0))


def cooling_time(start: Column, target: Column, environment: Column, k: Column) -> Column:
    """Seconds to cool to ``target``, or to just above the surroundings; 0 when already there."""
    floor = F.greatest(target, environment + F.lit(COOLING_EPSILON))
    usable = is_finite(start) & is_finite(target) & is_finite(environment) & is_finite(k)
    return F.when(
        usable & (k > 0) & (start > floor),
        -F.ln((floor - environment) / (start - environment)) / k,
    ).otherwise(F.lit(0.0))


# What a heat projection works out, one step from those before; each takes the columns so far by name.


def _rise(g: dict[str, Column]) -> dict[str, Column]:
    energy = jump_heat_energy(g["mass"], g["distance"], g["hull_mass"], g["calibration"])
    return {"rise": energy / (g["mass"] * g["specific_heat"])}


def _arrival(g: dict[str, Column]) -> dict[str, Column]:
    return {
        "arrival": F.greatest(F.coalesce(g["origin_ambient"], F.lit(0.0)), F.lit(0.0)) + g["rise"],
        "moving": g["distance"] > 0,
        "k": cooling_constant(g["mass"], g["specific_heat"], g["here_ambient"]),
        "around": F.coalesce(g["here_ambient"], F.lit(0.0)),
    }


def _cooling(g: dict[str, Column]) -> dict[str, Column]:
    return {
        "must_cool": g["moving"] & (g["arrival"] > HEAT_NOMINAL) & ~g["is_goal"] & ~g["next_is_gate"],
        "wait": cooling_time(g["arrival"], F.lit(HEAT_NOMINAL), g["around"], g["k"]),
    }


def _projection(g: dict[str, Column]) -> Column:
    warning = (
        F.when(g["moving"] & (g["arrival"] >= HEAT_CRITICAL), "CRITICAL")
        .when(g["moving"] & (g["arrival"] >= HEAT_OVERHEATED), "OVERHEATED")
    )
    cooled = g["must_cool"] & (g["wait"] > 0)
    usable = _positive(g["mass"]) & _positive(g["specific_heat"]) & is_finite(g["distance"]) & (g["distance"] >= 0)
    return F.when(
        usable & g["rise"].isNotNull(),
        F.struct(
            g["rise"].alias("hop_heat"),
            warning.alias("warning"),
            F.when(cooled, g["wait"]).alias("wait_seconds"),
            F.when(~g["moving"], F.lit(HEAT_NOMINAL))
            .when(cooled, F.greatest(F.lit(HEAT_NOMINAL), g["around"] + COOLING_EPSILON))
            .otherwise(g["arrival"])
            .alias("residual"),
            (~g["must_cool"] | (g["k"] > 0)).alias("can_proceed"),
        ),
    )


_HEAT_STEPS = (_rise, _arrival, _cooling)


def heat_projection(
    mass: Column,
    specific_heat: Column,
    hull_mass: Column,
    calibration: Column,
    distance: Column,
    origin_ambient: Column,
    here_ambient: Column,
    is_goal: Column,
    next_is_gate: Column,
) -> Column:
    """Heat of one jump as a struct ``(hop_heat, warning, wait_seconds, residual, can_proceed)``.

    The ship starts at the origin's ambient temperature (floored at 0 K, not at nominal). It waits
    only when above nominal with another jump to follow. Null when the inputs are unusable. For whole
    tables ``with_heat`` gives the same much faster.
    """
    given = {
        "mass": mass, "specific_heat": specific_heat, "hull_mass": hull_mass, "calibration": calibration, "distance": distance,
        "origin_ambient": origin_ambient, "here_ambient": here_ambient, "is_goal": is_goal, "next_is_gate": next_is_gate,
    }

    def after(g: dict[str, Column], steps: tuple) -> Column:
        if not steps:
            return _projection(g)
        return bound(values := steps[0](g), lambda s: after(g | {n: s[n] for n in values}, steps[1:]))

    return after({}, (lambda _: given, *_HEAT_STEPS))


def with_heat(rows: DataFrame, name: str, **given: Column) -> DataFrame:
    """``rows`` with ``heat_projection`` of the given columns as ``name``.

    Every step is a column of its own, so each is worked out once a row by generated code.
    """
    g, made = {}, []
    for step in (lambda _: given, *_HEAT_STEPS):
        values = {f"{name}_{n}": v for n, v in step(g).items()}
        rows = rows.withColumns(values)
        g |= {n.removeprefix(f"{name}_"): F.col(n) for n in values}
        made += values
    return rows.withColumn(name, _projection(g)).drop(*made)


def heat_distance_cap(
    ambient_at_start: Column, hull_mass: Column, specific_heat: Column, calibration: Column
) -> Column:
    """Longest jump that stays below critical from the start's ambient; null when it sets no limit."""
    headroom = F.lit(HEAT_CRITICAL) - F.coalesce(ambient_at_start, F.lit(0.0))
    return F.when(
        (headroom > 0) & (calibration > 0),
        headroom * (calibration * hull_mass * specific_heat) / 3.0,
    )
