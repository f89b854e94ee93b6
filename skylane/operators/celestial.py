"""Celestial counts, outermost bodies and ambient temperature per system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylane.functions.temperature import ambient_from_metres


def tagged_counts(celestials: DataFrame) -> DataFrame:
    """Bodies per system and kind, both kinds in one result."""
    return celestials.groupBy("system_id", "kind").agg(F.count(F.lit(1)).alias("bodies"))


def outermost_body(celestials: DataFrame) -> DataFrame:
    """Distance in metres of the body farthest from the star at the origin."""
    reach = F.sqrt(F.col("x_m") * F.col("x_m") + F.col("y_m") * F.col("y_m") + F.col("z_m") * F.col("z_m"))
    return (
        celestials.groupBy("system_id")
        .agg(F.max(reach).alias("outermost_m"))
        .where(F.col("outermost_m").isNotNull())
    )


def celestial_summary(celestials: DataFrame) -> DataFrame:
    """Counts and outermost distance in a single aggregation over planets and moons.

    Partial aggregation runs before the one shuffle, so a system with very many bodies costs its
    map-side rows only. A kind with no body is null rather than 0.
    """
    reach = F.sqrt(F.col("x_m") * F.col("x_m") + F.col("y_m") * F.col("y_m") + F.col("z_m") * F.col("z_m"))
    summary = celestials.groupBy("system_id").agg(
        F.count_if(F.col("kind") == "planet").alias("planets"),
        F.count_if(F.col("kind") == "moon").alias("moons"),
        F.max(reach).alias("outermost_m"),
    )
    return summary.select(
        "system_id",
        F.when(F.col("planets") > 0, F.col("planets")).cast("int").alias("planet_count"),
        F.when(F.col("moons") > 0, F.col("moons")).cast("int").alias("moon_count"),
        "outermost_m",
    )


def with_celestials(
    systems: DataFrame, celestials: DataFrame | None, has_planets: bool = True, model: str = "inverse_tangent"
) -> DataFrame:
    """Add ``planet_count``, ``moon_count`` and ``min_external_temp`` to systems.

    The temperature is that of the outermost body, so the lowest of the system. It is null without a
    positive luminosity, without a body away from the star, or when the map has no planet table.
    """
    if celestials is None:
        return systems.select(
            "*",
            F.lit(None).cast("int").alias("planet_count"),
            F.lit(None).cast("int").alias("moon_count"),
            F.lit(None).cast("double").alias("min_external_temp"),
        )
    summary = celestial_summary(celestials)
    kelvin = ambient_from_metres(F.col("outermost_m"), F.col("star_luminosity"), model)
    if not has_planets:
        kelvin = F.lit(None).cast("double")
    return (
        systems.join(summary, systems["id"] == summary["system_id"], "left")
        .withColumn("min_external_temp", F.when(F.col("outermost_m") > 0, kelvin))
        .drop("system_id", "outermost_m")
    )


def model_accuracy(measured: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Error of predictions against measurements.

    ``measured`` has ``name, measured_k, predicted_k``. Gives the mean and largest absolute error,
    where the largest occurs, and the share of rows within ``tolerance`` of the measurement.
    """
    error = F.abs(F.col("predicted_k") - F.col("measured_k"))
    close = error <= F.lit(tolerance) * F.abs(F.col("measured_k"))
    return measured.agg(
        F.count(F.lit(1)).alias("readings"),
        F.avg(error).alias("mean_error"),
        F.max(error).alias("max_error"),
        # Ties on the error go to the smallest name.
        F.min_by("name", F.struct((-error).alias("e"), F.col("name").alias("n"))).alias("worst"),
        F.avg(F.when(close, 1.0).otherwise(0.0)).alias("share_close"),
    )
