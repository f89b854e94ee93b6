"""Plans that must not grow with what they repeat or broadcast, and the answers they keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylane.functions.ship_physics import heat_projection, with_heat
from skylane.operators import enrich, names, tokens

_SHIP = {"ship_base_mass_kg": 1e7, "ship_specific_heat": 0.9, "loaded_fuel": 100.0, "loaded_cargo": 5.0, "heat_calibration": 1e-7}


def _hops(spark):
    schema = "request_id long, step int, method string, distance double, origin_temp double, min_external_temp double, is_goal boolean, next_is_gate boolean, fuel_quality double, dynamic_mass boolean"
    rows = [
        (1, 0, None, None, None, 10.0, False, False, 10.0, True),
        (1, 1, "jump", 30.0, 10.0, 20.0, False, False, 10.0, True),
        (1, 2, "gate", 50.0, 20.0, None, False, True, 10.0, True),
        (1, 3, "jump", 0.0, None, 5.0, True, False, 10.0, True),
        (2, 0, None, None, None, 10.0, False, False, 200.0, None),
        (2, 1, "jump", None, 10.0, 400.0, False, False, 200.0, None),
        (2, 2, "jump", float("nan"), 10.0, float("inf"), None, None, 200.0, None),
        (3, 1, None, 25.0, -5.0, 25.0, False, None, 1.0, False),
        (3, 2, "jump", 4000.0, 100.0, 5000.0, False, False, 1.0, False),
    ]
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit(v) for c, v in _SHIP.items()})


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_heat_is_worked_out_once(spark):
    """the rise was written into the plan hundreds of times."""
    assert _plan(enrich.hop_heat(_hops(spark))).count("heat_calibration") < 40


def test_heat_by_steps_is_the_expression(spark):
    given = dict(
        mass=F.col("ship_base_mass_kg") + 105.0, specific_heat=F.col("ship_specific_heat"), hull_mass=F.col("ship_base_mass_kg"),
        calibration=F.col("heat_calibration"), distance=F.col("distance"), origin_ambient=F.col("origin_temp"),
        here_ambient=F.col("min_external_temp"), is_goal=F.col("is_goal"), next_is_gate=F.col("next_is_gate"),
    )
    both = with_heat(_hops(spark).withColumn("one", heat_projection(**given)), "two", **given).select("one", "two").collect()
    assert [repr(r["one"]) for r in both] == [repr(r["two"]) for r in both]
    assert sum(r["one"] is not None for r in both) == 5


def test_fuel_of_a_hop_is_worked_out_once(spark):
    """a hop's price was written into the fold eleven times."""
    folded = enrich.fold_fuel(_hops(spark))
    assert _plan(folded).count("100000.0") == 1
    rows = {(r["request_id"], r["step"]): r for r in folded.collect()}
    first = (1e7 + 5.0 + 100.0) / 1e5 * 0.1 * 30.0
    assert rows[1, 1]["hop_cost"] == first and rows[1, 1]["warning"] == "REFUEL"
    assert rows[1, 2]["hop_cost"] == 0.0 and rows[1, 2]["remaining"] == 100.0
    assert rows[1, 3]["hop_cost"] is None and rows[2, 1]["hop_cost"] is None
    assert rows[3, 1]["hop_cost"] == (1e7 + 5.0 + 100.0) / 1e5 * 0.01 * 25.0


def test_tokens_are_made_once(spark):
    """waypoints and problems each packed the corpus again, and every field went through texts of bits."""
    rows = [(r, p, 30_000_000 + (r * 7919 + p * 104729) % (2**w - 1), p % 5) for r, w in enumerate((1, 5, 9, 17, 30), 1) for p in range(70)]
    made = spark.createDataFrame(rows, "route_id long, pos int, system_id long, waypoint_type int")
    text = tokens.pack_tokens(made).select("route_id", tokens.token_text().alias("token"))
    back = tokens.unpack_tokens(text)
    assert "collect_list" not in _plan(back)
    assert sorted(map(tuple, back.collect())) == sorted((*r, None) for r in rows)


def test_characters_of_names_are_not_broadcast(spark):
    """every name, once per character and with all of them, was broadcast."""
    held = spark.createDataFrame([(f"Customer#{i:09d}",) for i in range(40)], "name string")
    asked = spark.createDataFrame([("Customer#12",), ("customer",)], "query string")
    pairs = names.similar_pairs(asked, held)
    plan = _plan(pairs, "sparkPlan")
    assert "SortMergeJoin [char" in plan
    assert {r["query"] for r in pairs.collect()} == {"Customer#12", "customer"}


def test_lookups_are_broadcast_by_count_only(spark, monkeypatch):
    """F8, F10, F11: Spark took systems and orders for small by their files and built them on the driver."""
    from skylane import session
    from skylane.operators import edges
    from skylane.plans.sample_map import SampleMap
    from tests.conftest import SAMPLE

    monkeypatch.setattr(session, "BROADCAST_ROWS", 3)
    places = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(6)], "id long, x double, y double, z double")
    jumps = spark.createDataFrame([(0, 1), (1, 2), (5, 9), (None, 1)], "src long, dst long")
    pairs = edges.gate_pairs(jumps, places)
    gates = edges.gate_edges(pairs, places)
    assert "BroadcastHashJoin" not in _plan(gates, "sparkPlan")
    assert sorted(map(tuple, gates.collect())) == [(a, b, "gate", 1.0) for a, b in ((0, 1), (1, 0), (1, 2), (2, 1))]
    moons = SampleMap(spark, SAMPLE).tables["Moons"]
    assert "BroadcastHashJoin" not in _plan(moons, "sparkPlan")
