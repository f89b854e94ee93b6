"""Ambient temperature models as column expressions.

Inputs the models cannot take (negative distance, non-positive luminosity) give null; ``*_problem``
names the reason so that callers can keep it beside the value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit conversions and model constants.
METRES_PER_LIGHT_SECOND = 299_792_458.0
METRES_PER_AU = 1.495978707e11
STEFAN_BOLTZMANN = 5.670374419e-8
FLUX_NORMALISATION = 1.0e-21
LOGISTIC_SCALE = 3.215e-11
LOGISTIC_EXPONENT = 1.25
LOGISTIC_MIN_K = 0.1
LOGISTIC_MAX_K = 99.9


def temperature_problem(distance: Column, luminosity: Column) -> Column:
    """Why a model has no answer, or null when it has one."""
    return (
        F.when(distance < 0, F.lit("distance_range"))
        .when(luminosity <= 0, F.lit("luminosity_range"))
    )


def _answerable(distance: Column, luminosity: Column) -> Column:
    return (distance >= 0) & (luminosity > 0)


def inverse_tangent(distance_ls: Column, luminosity: Column) -> Column:
    """Default model: arctangent (in gradians) of the root of the normalised radiative flux."""
    flux = luminosity / (distance_ls * distance_ls)
    # A body at the star itself receives infinite flux; the arctangent then reaches 100 gradians.
    kelvin = F.when(distance_ls == 0, F.lit(100.0)).otherwise(
        F.atan(F.sqrt(flux * F.lit(FLUX_NORMALISATION))) * F.lit(200.0 / math.pi)
    )
    return F.when(_answerable(distance_ls, luminosity), kelvin)


def logistic(
    distance_ls: Column,
    luminosity: Column,
    *,
    k: float = LOGISTIC_SCALE,
    b: float = LOGISTIC_EXPONENT,
    min_kelvin: float = LOGISTIC_MIN_K,
    max_kelvin: float = LOGISTIC_MAX_K,
    offset: float | None = None,
    scale: float | None = None,
) -> Column:
    """Fitted sigmoid between ``max_kelvin`` at the star and ``min_kelvin`` in deep space."""
    ratio = distance_ls / (F.lit(k) * F.sqrt(luminosity))
    kelvin = F.lit(min_kelvin) + F.lit(max_kelvin - min_kelvin) / (1 + F.pow(ratio, F.lit(b)))
    if offset is not None or scale is not None:
        kelvin = F.lit(offset or 0.0) + F.lit(1.0 if scale is None else scale) * kelvin
    return F.when(_answerable(distance_ls, luminosity), kelvin)


MODELS = {"inverse_tangent": inverse_tangent, "logistic": logistic}


def ambient(distance_ls: Column, luminosity: Column, model: str = "inverse_tangent") -> Column:
    """Temperature at a distance in light-seconds under the named model."""
    return MODELS[model](distance_ls, luminosity)


def ambient_from_metres(distance_m: Column, luminosity: Column, model: str = "inverse_tangent") -> Column:
    return ambient(distance_m / F.lit(METRES_PER_LIGHT_SECOND), luminosity, model)


def ambient_from_au(distance_au: Column, luminosity: Column, model: str = "inverse_tangent") -> Column:
    return ambient_from_metres(distance_au * F.lit(METRES_PER_AU), luminosity, model)


def stefan_boltzmann(distance_m: Column, luminosity: Column) -> Column:
    """Black-body equilibrium temperature; null unless distance and luminosity are positive."""
    flux = luminosity / (
        F.lit(16.0 * math.pi * STEFAN_BOLTZMANN) * distance_m * distance_m
    )
    return F.when((distance_m > 0) & (luminosity > 0), F.pow(flux, F.lit(0.25)))
