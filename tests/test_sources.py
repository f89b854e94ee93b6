import pytest
from pyspark.sql import functions as F

from skylane.operators.edges import adjacency, dangling_report, gate_edges, gate_pairs
from skylane.operators import edges
from skylane.sources import datasets, starmap
from skylane.sources.corpus import corpus_routes, corpus_steps, read_corpus_csv
from skylane.sources.ships import MissingShipColumns, checked_ships, load_ships, match_headers, read_ship_csv


def legacy(spark):
    return {
        "mapSolarSystems": spark.createDataFrame(
            [(1, "Alpha"), (2, "Beta"), (3, "Gamma")], "solarSystemID long, solarSystemName string"
        ),
        "mapSolarSystemJumps": spark.createDataFrame([(1, 2), (2, 3)], "fromSolarSystemID long, toSolarSystemID long"),
    }


def test_legacy_layout(spark):
    tables = legacy(spark)
    assert starmap.detect_layout(tables).name == "legacy"
    systems = starmap.load_systems(tables)
    assert systems.where("region_id is null and x is null").count() == 3
    assert gate_pairs(starmap.load_jumps(tables), systems).count() == 4


def test_current_layout_wins_and_missing_parts_become_null(spark):
    tables = legacy(spark)
    tables["solarsystems"] = spark.createDataFrame(
        [(1, "A", 1e16, 0.0, 0.0), (2, "B", float("nan"), 0.0, 0.0)],
        "solarSystemId long, name string, X double, Y double, Z double",
    )
    tables["jumps"] = spark.createDataFrame([(1, 2)], "fromSystemId long, toSystemId long")
    layout = starmap.detect_layout(tables)
    assert layout.name == "static" and layout.position == ("x", "y", "z") and layout.regions is None
    rows = {r["id"]: r for r in starmap.load_systems(tables, layout).collect()}
    assert rows[1]["x"] == pytest.approx(1e16 / 9.4607304725808e15) and rows[1]["star_luminosity"] is None
    # One unusable coordinate drops the position, not the system.
    assert rows[2]["x"] is None and rows[2]["y"] is None


def test_unknown_layout_is_rejected(spark):
    with pytest.raises(starmap.UnsupportedSchema):
        starmap.detect_layout({"SolarSystems": spark.range(1)})


def test_gate_lengths_and_dangling_ends(spark):
    systems = spark.createDataFrame(
        [(1, 0.0, 0.0, 0.0), (2, 3.0, 4.0, 0.0), (3, None, None, None)], "id long, x double, y double, z double"
    )
    jumps = spark.createDataFrame([(1, 2), (2, 3), (1, 9), (8, 9), (1, 1)], "src long, dst long")
    pairs = gate_pairs(jumps, systems)
    lengths = {(r["src"], r["dst"]): r["distance"] for r in gate_edges(pairs, systems).collect()}
    assert lengths == {(1, 2): 5.0, (2, 1): 5.0, (2, 3): 1.0, (3, 2): 1.0, (1, 1): 0.0}
    report = [tuple(r) for r in dangling_report(jumps, systems).collect()]
    assert sorted(report) == [("skipped", None, 2), ("unknown_id", 8, 1), ("unknown_id", 9, 2)]


def test_a_hub_has_the_shape_of_any_other_system(spark):
    pairs = spark.range(100).select(F.lit(1).cast("long").alias("src"), F.col("id").alias("dst"))
    systems = spark.createDataFrame([(1,), (500,)], "id long")
    rows = [(r["src"], r["dst"]) for r in adjacency(pairs, systems).collect()]
    assert rows == [(1, i) for i in range(100)] + [(500, None)]


def test_ship_catalogue(spark, tmp_path):
    path = tmp_path / "ships.csv"
    path.write_text(
        "Ship Name, mass_kg ,specificheat_c,fuel_capacity,capacity_m^3\n"
        " Reflex ,10000000,0.9,1750,800000\nWarden,x,1.1,1400,500000\nreflex,1,1,1,1\nZero,0,1,1,1\nGood,1,1,1,1\n"
    )
    raw = read_ship_csv(spark, str(path))
    raw = raw.withColumnRenamed("Ship Name", "ship_name")
    problems = {(r["name"], r["problem"]) for r in checked_ships(raw).collect()}
    assert ("Warden", "base_mass_kg_unreadable") in problems
    assert ("Zero", "base_mass_kg_range") in problems
    assert {n for n, p in problems if p == "name_repeated"} == {"Reflex", "reflex"}
    assert [r["name"] for r in load_ships(raw).collect()] == ["Good"]
    assert match_headers(["Name", "Mass", "SpecificHeat", "fuelCapacity", "capacity_m^3"])["cargo_capacity"] == "capacity_m^3"
    with pytest.raises(MissingShipColumns):
        match_headers(["name"])


def test_corpus_csv(spark, tmp_path):
    path = tmp_path / "routes.csv"
    path.write_text(
        "routeId,startSolarSystemId,endSolarSystemId,avoidGates,maxLightyears,discoveredPath\n"
        '7,1,3,true,80.5,"[{""Id"":1,""Name"":""A""},{""Id"":3,""Name"":""C, D""}]"\n'
    )
    steps = corpus_steps(corpus_routes(read_corpus_csv(spark, str(path)))).orderBy("pos").collect()
    assert [(s["route_id"], s["pos"], s["system_id"], s["name"], s["avoid_gates"], s["max_ly"]) for s in steps] == [
        (7, 0, 1, "A", True, 80.5), (7, 1, 3, "C, D", True, 80.5)
    ]


def test_fingerprint_ignores_order_but_not_content(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (2, None, 1.5)], "k long, s string, d double")
    same = datasets.fingerprint(a.orderBy(F.desc("k"))).first()
    assert datasets.fingerprint(a).first() == same
    assert datasets.fingerprint(a.union(a)).first()["fingerprint"] != same["fingerprint"]
    assert datasets.fingerprint(a.withColumn("s", F.lit("x"))).first()["fingerprint"] != same["fingerprint"]


def _print(spark, rows, schema):
    return datasets.fingerprint(spark.createDataFrame(rows, schema)).first()["fingerprint"]


def test_fingerprint_tells_apart_what_shares_a_text(spark):
    two = "a string, b string"
    assert _print(spark, [("a|b", "c")], two) != _print(spark, [("a", "b|c")], two)
    assert _print(spark, [("a", "s1:b")], two) != _print(spark, [("as1:b", "")], two)
    assert _print(spark, [(None, "x")], two) != _print(spark, [("~", "x")], two)
    assert _print(spark, [("", None)], two) != _print(spark, [(None, "")], two)
    assert _print(spark, [("1",)], "a string") != _print(spark, [(1,)], "a long")
    nested = "a array<array<string>>, r struct<x:int,y:int>"
    assert _print(spark, [([["a"], ["b"]], (1, None))], nested) != _print(spark, [([["a", "b"]], (1, None))], nested)
    assert _print(spark, [([], (None, None))], nested) != _print(spark, [([], None)], nested)
    assert _print(spark, [([None], None)], nested) != _print(spark, [([], None)], nested)


def test_exact_bits_of_doubles(spark):
    import math
    import random
    import struct

    r = random.Random(4)
    values = [0.0, -0.0, 1.0, -1.0, 1e-5, 2e-5, 1e36, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, math.nan]
    values += [math.nextafter(2.0**k, s) for k in range(-1060, 1024, 7) for s in (0, math.inf)] + [2.0**k for k in range(-1074, 1024, 5)]
    values += [v for v in (struct.unpack("d", r.randbytes(8))[0] for _ in range(3_000)) if v == v]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", datasets.exact_bits(F.col("v")).alias("bits")).collect()

    def back(text):
        if text == "nan":
            return math.nan
        size = {"inf": math.inf, "0": 0.0}.get(text[1:])
        if size is None:
            e, m = text[1:].split(".")
            size = math.ldexp(int(m), int(e) - 52)
        return -size if text[0] == "-" else size

    assert all(struct.pack("d", back(row.bits)) == struct.pack("d", row.v) for row in rows)
    assert datasets.fingerprint(spark.createDataFrame([(None, 1)], "v double, w long")).first()["row_count"] == 1


def test_manifest_round_trip(spark, tmp_path):
    tables = {"A": spark.range(5).toDF("id"), "B": spark.createDataFrame([], "x double")}
    datasets.record_manifest(tables, str(tmp_path / "m"), "e6")
    held = datasets.read_manifest(spark, str(tmp_path / "m"))
    assert {(r.table_name, r.status) for r in datasets.freshness(datasets.manifest(tables, "e6"), held, strict=True).collect()} == {("A", "fresh"), ("B", "fresh")}
    other = datasets.manifest({"A": spark.range(4).union(spark.range(1)).toDF("id"), "B": tables["B"]}, "e7")
    assert {(r.table_name, r.status) for r in datasets.freshness(other, held).collect()} == {("A", "stale"), ("B", "fresh")}
    assert {r.status for r in datasets.freshness(other, held, strict=True).collect()} == {"stale"}


def test_release_tag(spark, tmp_path):
    marker = spark.createDataFrame([("requested=latest",), ("resolved= e6 ",)], "value string")
    assert datasets.release_tag(marker).first()["release_tag"] == "e6"
    path = tmp_path / "marker"
    path.write_text("requested=latest\nresolved=\nresolved= e7 c \r\nresolved=e1\n")
    assert datasets.release_tag(datasets.read_marker(spark, str(path))).first()["release_tag"] == "e7 c"
    assert datasets.release_tag(spark.createDataFrame([("nothing",)], "value string")).collect() == []


def test_spatial_layout_round_trip(spark, tmp_path):
    systems = spark.createDataFrame(
        [(i, float(i), 0.0, -float(i), 5.0) for i in range(50)], "id long, x double, y double, z double, min_external_temp double"
    )
    path = str(tmp_path / "cells")
    datasets.write_system_cells(datasets.system_cells(systems, 7.0), path, fingerprint_text="f", release_tag="t", slabs=4)
    cells = datasets.read_system_cells(spark, path)
    assert cells.count() == 50 and cells.where("source_fingerprint = 'f' and built_at is not null").count() == 50
    found = datasets.lookup(spark.createDataFrame([(3,), (99,)], "id long"), cells).collect()
    assert [(r["id"], r["x"], r["z"]) for r in found] == [(3, 3.0, -3.0)]


def test_the_stored_layout_skips_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    systems = spark.createDataFrame(
        [(i, (i * 7919 % 1009) - 500.0, (i * 104729 % 997) - 500.0, (i * 1299709 % 991) - 500.0, 1.0) for i in range(40_000)],
        "id long, x double, y double, z double, min_external_temp double",
    )
    path = str(tmp_path / "cells")
    datasets.write_system_cells(datasets.system_cells(systems, 50.0), path, fingerprint_text="f", slabs=8, group_bytes=20_000)
    low, high = (-4, 1, -6), (-2, 3, -5)
    cells = datasets.read_system_cells(spark, path)
    found = datasets.cells_in_box(cells, low, high)
    brute = cells.where("cx between -4 and -2 and cy between 1 and 3 and cz between -6 and -5")
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in brute.collect()) != []
    kept = groups = 0
    for file in (tmp_path / "cells").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            groups += 1
            kept += all(stats[c].max >= a and stats[c].min <= b for c, a, b in zip(("cx", "cy", "cz"), low, high))
    assert groups >= 40 and kept <= groups / 4
