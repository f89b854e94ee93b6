import math
import random

import pytest
from pyspark.sql import functions as F

from skylane import session
from skylane.operators import edges, spatial
from skylane.operators.spatial import nearest, radius_join


def points(spark, kind):
    rng = random.Random(5)
    if kind == "even":
        rows = [(i, rng.uniform(0, 100), rng.uniform(0, 100), rng.uniform(0, 10)) for i in range(300)]
    elif kind == "crowded":
        # A third at one place, a third in a tight cluster, the rest far apart.
        rows = [(i, 5.0, 5.0, 5.0) for i in range(100)]
        rows += [(100 + i, 50 + rng.random() / 100, 50 + rng.random() / 100, 1.0) for i in range(100)]
        rows += [(200 + i, rng.uniform(-1e4, 1e4), rng.uniform(-1e4, 1e4), 0.0) for i in range(100)]
    else:
        rows = [(i, float(i), 0.0, 0.0) for i in range(60)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, z double")


def gap(a, b):
    return math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2)


@pytest.mark.parametrize("kind", ["even", "crowded", "line"])
@pytest.mark.parametrize("k, radius", [(1, None), (7, None), (7, 12.0), (400, None)])
def test_nearest_equals_brute_force(spark, kind, k, radius):
    rows, df = points(spark, kind)
    queries = df.select(F.col("id").alias("query_id"), "x", "y", "z", F.lit(k).alias("k"), F.lit(radius).cast("double").alias("radius"))
    got = nearest(queries, df, keep=F.col("query_id") != F.col("id"), per_place=k + 1)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for a in rows:
        near = sorted((gap(a, b), b[0]) for b in rows if b[0] != a[0])
        expected = [i for d, i in near if radius is None or d <= radius][:k]
        assert [i for _, i in sorted(found.get(a[0], []))] == expected


@pytest.mark.parametrize("share", [4_096, 3])
def test_radius_join_equals_brute_force_with_and_without_salt(spark, monkeypatch, share):
    monkeypatch.setattr(spatial, "CELL_SHARE", share)
    rows, df = points(spark, "crowded")
    got = {(r["query_id"], r["id"]) for r in radius_join(df.withColumnRenamed("id", "query_id"), df, 2.0).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if gap(a, b) <= 2.0}
    assert radius_join(df.withColumnRenamed("id", "query_id"), df, 0.0).count() == 0


def test_radius_is_inclusive(spark):
    _, df = points(spark, "line")
    got = radius_join(df.withColumnRenamed("id", "query_id"), df, 1.0).where("query_id = 10")
    assert sorted(r["id"] for r in got.collect()) == [9, 10, 11]


def test_a_query_with_too_few_matches_does_not_meet_the_map(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, rng.uniform(0, 1000), rng.uniform(0, 1000), rng.uniform(0, 1000), rng.choice([None, *[rng.uniform(0, 100)] * 9]), rng.randint(0, 3)) for i in range(2_000)]
    targets = spark.createDataFrame(rows, "id long, x double, y double, z double, heat double, tags int")
    asked = []
    for i in range(60):
        limit = [None, 0.01, 1.0, 30.0, 99.0][i % 5]
        asked.append((i, *rows[i][1:4], [1, 5, 40][i % 3], [None, 200.0][i % 2], limit, i % 4, 1))
    queries = spark.createDataFrame(asked, "query_id long, x double, y double, z double, k int, radius double, heat_limit double, shuns int, slack int")
    met, whole = [], spatial._block_join

    def counting(*args):
        pairs = whole(*args)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(spatial, "_block_join", counting)
    keep = (
        (F.col("query_id") != F.col("id")) & (F.col("tags").bitwiseAND(F.col("shuns")) == 0)
        & (F.col("heat_limit").isNull() | F.col("heat").isNull() | (F.col("heat") <= F.col("heat_limit")))
    )
    found = {}
    for r in nearest(queries, targets, keep=keep).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for q, x, y, z, k, radius, limit, shuns, _ in asked:
        fit = [b for b in rows if b[0] != q and not b[5] & shuns and (limit is None or b[4] is None or b[4] <= limit)]
        near = sorted((gap((q, x, y, z), b), b[0]) for b in fit)
        assert [i for _, i in sorted(found.get(q, []))] == [i for d, i in near if radius is None or d <= radius][:k]
    # Few fit: a thousand queries that each ask for more than there is meet no cell at all.
    met.clear()
    cold = targets.where("heat is not null")
    many = spark.range(1_000).select(F.col("id").alias("query_id"), *[(F.rand(i) * 1000).alias(c) for i, c in enumerate("xyz")], F.lit(30).alias("k"), F.lit(None).cast("double").alias("radius"), F.lit(0.5).alias("heat_limit"), F.lit(0).alias("shuns"), F.lit(1).alias("slack"))
    there = sum(1 for b in rows if b[4] is not None and b[4] <= 0.5)
    answers = nearest(many, cold, keep=F.col("heat") <= F.col("heat_limit")).groupBy("query_id").count().collect()
    assert there < 30 and {r["count"] for r in answers} == {there} and sum(met) == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counted_sides_are_not_broadcast_by_their_files(spark, monkeypatch):
    """Copies under sub-keys or cells are many more rows than the small files they come from."""
    _, df = points(spark, "even")
    queries = df.withColumnRenamed("id", "query_id")
    expected = {tuple(r) for r in radius_join(queries, df, 20.0).select("query_id", "id").collect()}
    monkeypatch.setattr(session, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 100, raising=False)
    looked_up = session.spread_lookup(queries.select("query_id"), df.withColumnRenamed("id", "query_id"), "query_id", "query_id", 300)
    assert looked_up.count() == 300
    assert "Broadcast" not in plan_of(looked_up)
    near = radius_join(queries, df, 20.0)
    assert {tuple(r) for r in near.select("query_id", "id").collect()} == expected
    assert "SortMergeJoin [c" in plan_of(near)


def test_radius_graphs_meet_their_limits_where_pairs_are_formed(spark):
    """No join stands above the one that forms the pairs."""
    _, df = points(spark, "even")
    systems = df.withColumn("min_external_temp", (F.col("id") % 60).cast("double"))
    graphs = edges.graph_table(spark, [edges.NeighbourGraph(1, 15.0, 30.0), edges.NeighbourGraph(2, 25.0)])
    found = edges.neighbour_edges(systems, graphs)
    rows = systems.collect()
    close = {(g, a["id"], b["id"]) for a in rows for b in rows for g, reach, heat in ((1, 15.0, 30.0), (2, 25.0, 99.0))
             if a["id"] != b["id"] and gap(a, b) <= reach and b["min_external_temp"] <= heat}
    assert {(r["graph_id"], r["src"], r["dst"]) for r in found.collect()} == close
    joins = [line for line in plan_of(found).splitlines() if "Join" in line and "[c" not in line]
    assert joins == []
