import pytest
from pyspark.sql import functions as F

from skylane.operators.ordered import running_total, with_neighbours
from skylane.operators import tokens


@pytest.mark.parametrize("block", [1, 3, 100])
def test_blocks_do_not_show(spark, block):
    rows = spark.range(20).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).cast("int").alias("i"), F.col("id").alias("v"))
    near = with_neighbours(rows, "k", "i", ["v"], block).orderBy("k", "i").collect()
    assert len(near) == 20
    for r in near:
        assert r["prev_v"] == (None if r["i"] == 0 else r["v"] - 2) and r["next_v"] == (None if r["i"] == 9 else r["v"] + 2)
    for r in running_total(rows, "k", "i", "v", "t", block).collect():
        assert r["t"] == sum(r["k"] + 2 * j for j in range(r["i"] + 1))


def test_token_widths_and_problems(spark):
    base = tokens.BASE_SYSTEM_ID
    rows = [(1, 0, base, 0), (2, 0, base + 2**30 - 1, 0), (2, 1, base, 4), (3, 0, base - 1, 0), (4, 0, base + 2**30, 0), (5, 0, base, 9)]
    got = {r["route_id"]: r for r in tokens.pack_tokens(
        spark.createDataFrame(rows, "route_id long, pos int, system_id long, waypoint_type int")).collect()}
    assert got[1]["bit_width"] == 1 and got[1]["payload"] == "00"
    assert got[2]["bit_width"] == 30
    assert got[3]["problem"] == "system id below base"
    assert got[4]["problem"] == "bit width out of range"
    assert got[5]["problem"] == "invalid waypoint type"


@pytest.mark.parametrize("stops, problem", [(65_535, None), (65_536, "too many waypoints")])
def test_token_length_limit_and_round_trip(spark, stops, problem):
    rows = spark.range(stops).select(
        F.lit(1).cast("long").alias("route_id"), F.col("id").cast("int").alias("pos"),
        (F.col("id") * 7 % 9973 + tokens.BASE_SYSTEM_ID).alias("system_id"), (F.col("id") % 5).cast("int").alias("waypoint_type"),
    )
    packed = tokens.pack_tokens(rows)
    assert packed.first()["problem"] == problem
    if problem is None:
        text = packed.select("route_id", tokens.token_text().alias("token"))
        back = tokens.unpack_tokens(text).select("route_id", "pos", "system_id", "waypoint_type")
        assert back.count() == stops and back.exceptAll(rows).isEmpty()
