"""Hops: what travels, and the same rows as by hand."""

from pyspark.sql import functions as F

from skylane.operators import enrich


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hops_move_only_ids_to_the_gates(spark):
    systems = [(i, f"s{i}", float(i), 0.0, 0.0, 10.0 * i) for i in range(5)]
    systems = spark.createDataFrame(systems, "id long, name string, x double, y double, z double, min_external_temp double")
    systems = systems.withColumns({c: F.lit(None).cast("int") for c in ("planet_count", "moon_count")}).withColumn(
        "star_temperature", F.lit(None).cast("double")
    )
    walks = [(1, 0, 0), (1, 1, 1), (1, 2, 3), (1, 3, 4), (2, 0, 2), (2, 1, 2), (3, 0, 9)]
    steps = spark.createDataFrame(walks, "request_id long, step int, system_id long")
    pairs = spark.createDataFrame([(1, 3), (3, 1), (2, 2)], "src long, dst long")
    hops = enrich.with_hops(enrich.with_systems(steps, systems), pairs)
    got = {(r["request_id"], r["step"]): (r["method"], r["distance"], r["origin_temp"], r["is_goal"], r["next_is_gate"]) for r in hops.collect()}
    assert got == {
        (1, 0): (None, None, None, False, False),
        (1, 1): ("jump", 1.0, 0.0, False, True),
        (1, 2): ("gate", 2.0, 10.0, False, False),
        (1, 3): ("jump", 1.0, 30.0, True, False),
        (2, 0): (None, None, None, False, True),
        (2, 1): ("gate", 0.0, 20.0, True, False),
        (3, 0): (None, None, None, True, False),
    }
    assert "Exchange hashpartitioning" not in plan_of(hops)
