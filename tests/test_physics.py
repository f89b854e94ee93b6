import math

import pytest
from pyspark.sql import functions as F

from skylane.functions import ship_physics as p
from skylane.functions.temperature import inverse_tangent, logistic, stefan_boltzmann
from skylane.functions.text import cooldown_text, is_developer_system, jaro_winkler, status_class
from skylane.operators.celestial import model_accuracy
from skylane.operators.enrich import fold_fuel, running_fuel

MEASURED = [
    ("A9R-PQ4", 1168.0, 117079286879216367304704.0, 0.6),
    ("O86-215", 3078.0, 210611439263697778669256704.0, 0.0),
    ("E37-N15", 2735.0, 46609614223656827010154496.0, 5.1),
    ("UVG-MV3", 6283.0, 2399495653136391448790302720.0, 15.7),
    ("U98-VK4", 20850.0, 95197165897008878019531505664.0, 28.4),
    ("EKF-2N4", 1297.0, 3482357323030063141093376.0, 2.9),
    ("ER7-MN4", 165.0, 5945032820976178790662144.0, 28.3),
    ("E6S-8S4", 3290.0, 526627990081004722192384.0, 0.4),
    ("O43-CT4", 532.0, 269067787727477819523989504.0, 49.9),
    ("E17-S05", 17.0, 705658793434329632473088.0, 63.3),
]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(float(x))


def test_temperature_models_meet_their_published_accuracy(spark):
    rows = spark.createDataFrame(MEASURED, "name string, d double, l double, measured_k double")
    for model in (inverse_tangent, logistic):
        r = model_accuracy(rows.withColumn("predicted_k", model(F.col("d"), F.col("l")))).first()
        assert r["readings"] == 10 and r["mean_error"] < 3 and r["max_error"] < 10
        assert r["worst"] == "O86-215"


def test_temperature_rejects_bad_inputs(spark):
    assert value(spark, inverse_tangent(lit(-1), lit(1e26))) is None
    assert value(spark, inverse_tangent(lit(1), lit(0))) is None
    assert value(spark, stefan_boltzmann(lit(0), lit(1))) is None
    assert value(spark, stefan_boltzmann(lit(1.496e11), lit(3.828e26))) == pytest.approx(279, abs=5)


@pytest.mark.parametrize(
    "mass, ly, rise", [(12_383_006, 18.95, 70.39738911), (12_383_006, 38.26, 142.132142868), (10_001_750, 18.95, 56.85994875)]
)
def test_jump_heat(spark, mass, ly, rise):
    energy = p.jump_heat_energy(lit(mass), lit(ly), lit(1e7), lit(1))
    assert value(spark, energy) == pytest.approx(rise, abs=0.01)


def test_cooling(spark):
    assert value(spark, p.cooling_constant(lit(1e6), lit(1), lit(30))) == 1.0
    assert value(spark, p.cooling_time(lit(100), lit(60), lit(30), lit(1))) == pytest.approx(math.log(70 / 30))
    assert value(spark, p.cooling_time(lit(100), lit(10), lit(30), lit(1))) == pytest.approx(-math.log(0.01 / 70))
    assert value(spark, p.cooling_time(lit(20), lit(30), lit(5), lit(1))) == 0.0


@pytest.mark.parametrize("start, ly, warning", [(89.9, 1.0, "OVERHEATED"), (149.9, 1.0, "CRITICAL"), (50.0, 15.0, None)])
def test_heat_warnings_start_from_the_ambient_temperature(spark, start, ly, warning):
    heat = p.heat_projection(
        lit(1e5), lit(1e3), lit(1e5), lit(1e-7), lit(ly), lit(start), lit(0), F.lit(True), F.lit(False)
    )
    got = value(spark, heat)
    assert got["warning"] == warning
    assert got["residual"] == pytest.approx(start + got["hop_heat"])


def test_gate_leaves_the_ship_at_nominal(spark):
    heat = p.heat_projection(lit(1e5), lit(1), lit(1e5), lit(1e-7), lit(0), lit(200), lit(0), F.lit(False), F.lit(False))
    got = value(spark, heat)
    assert (got["hop_heat"], got["warning"], got["residual"], got["can_proceed"]) == (0.0, None, 30.0, True)


def _route(spark, dynamic):
    load = (10_000_000.0, 1750.0, 633_006.0, 10.0, dynamic)
    rows = [(1, 0, None, None, *load)]
    rows += [(1, i + 1, d, "jump", *load) for i, d in enumerate((18.95, 38.26, 23.09))]
    return spark.createDataFrame(
        rows,
        "request_id long, step int, distance double, method string, ship_base_mass_kg double, loaded_fuel double, "
        "loaded_cargo double, fuel_quality double, dynamic_mass boolean",
    )


def test_fuel_of_a_route(spark):
    static = running_fuel(_route(spark, False).where("step > 0")).orderBy("step").collect()
    assert static[0]["hop_cost"] == pytest.approx(201.5286262, abs=1e-6)
    assert static[-1]["cumulative"] == pytest.approx(853.9709068, abs=1e-6)
    assert static[-1]["remaining"] == pytest.approx(896.0290932, abs=1e-6)
    dynamic = fold_fuel(_route(spark, True), refuel=False).orderBy("step").collect()
    assert dynamic[-1]["remaining"] == pytest.approx(896.0508517954859, abs=1e-9)
    assert dynamic[-1]["cumulative"] < static[-1]["cumulative"]


def test_fold_in_small_blocks_gives_the_same(spark):
    hops = _route(spark, True)
    whole = fold_fuel(hops).orderBy("step").collect()
    assert fold_fuel(hops, block=1).orderBy("step").collect() == whole


def test_refuel_resets_to_the_load_and_is_not_deducted(spark):
    hops = _route(spark, False).withColumn("loaded_fuel", F.lit(300.0))
    rows = fold_fuel(hops).orderBy("step").collect()
    assert [r["warning"] for r in rows] == [None, "REFUEL", None]
    assert rows[1]["remaining"] == 300.0


def test_small_text(spark):
    assert value(spark, cooldown_text(lit(124))) == "2m4s"
    assert value(spark, cooldown_text(lit(-3))) == "0s"
    assert value(spark, cooldown_text(lit(1e9))) == "1440m0s"
    assert value(spark, status_class(F.lit(404))) == "4xx" and value(spark, status_class(F.lit(700))) == "other"
    for name, hidden in [("AD0", True), ("AD035", True), ("V-001", True), ("AD", False), ("ad035", False),
                         ("AD03X", False), ("V-0X1", False), ("ADVL-1", False)]:
        assert value(spark, is_developer_system(F.lit(name))) is hidden


def test_similarity(spark):
    pairs = [("Bran", "Brana", 0.96), ("2L2", "H:2L2S", 0.8333333333), ("", "x", 0.0), ("", "", 1.0), ("abc", "xyz", 0.0),
             ("MARTHA", "MARHTA", 0.9611111111), ("DIXON", "DICKSONX", 0.8133333333)]
    rows = spark.createDataFrame(pairs, "a string, b string, expected double")
    for r in rows.select("expected", jaro_winkler(F.col("a"), F.col("b")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["expected"])
