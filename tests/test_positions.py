"""Row numbers by ranges against the plain window."""

import re

import pytest
from pyspark.sql import Window, functions as F

from tastegrid.operators import hybrid, positions, prepare, profiles
from tastegrid.operators import positions
from tastegrid.operators.positions import with_positions, with_positions_by_key


def exchanges(df):
    """What the exchanges that the planner added deal out by."""
    return re.findall(r"hashpartitioning\(([^)]*)\), ENSURE_REQUIREMENTS", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def entries(spark, n=900):
    rows = [("hot" if i % 3 == 0 else f"u{i % 40}" if i % 41 else None, f"b{i}", float(i % 5 + 1) if i % 7 else None, i % 11 or None) for i in range(n)]
    return spark.createDataFrame(rows, "user_id string, business_id string, stars double, date int")


def test_hot_key_nulls_and_clashing_names(spark):
    rows = [("hot", i % 37, i) for i in range(3_000)] + [(f"u{i % 50}", i % 7, i) for i in range(500)]
    rows += [(None, 3, 1), (None, None, 2), ("one", None, 5)]
    df = spark.createDataFrame(rows, "k0 string, at int, row int").repartition(7)
    order = [F.col("at").asc_nulls_last(), F.col("row")]
    got = with_positions(df, ["k0"], order, "pos", "n")
    w = Window.partitionBy("k0").orderBy(*order)
    want = df.withColumn("pos", F.row_number().over(w).cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k0")))
    assert got.columns == ["k0", "at", "row", "pos", "n"]
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_hot_key_is_dealt_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).select(F.when(F.col("id") < 20_000, -1).otherwise(F.col("id")).alias("u"), "id")
        by = [F.col("u").asc_nulls_first(), F.col("id")]
        sizes = df.repartitionByRange(*by).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 2 * 40_000 / len(sizes)
        assert len(sizes) > 1
        got = with_positions(df, ["u"], [F.col("id")])
        assert got.where("u = -1 and position != id + 1").count() == 0
        assert got.where("u != -1 and position != 1").count() == 0 and got.count() == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_and_several_keys(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "a", 1), (1, "b", 2), (2, "a", 9)], "x int, y string, z int")
    got = {(r.x, r.y, r.z): (r.position, r.t) for r in with_positions(df, ["x", "y"], [F.desc("z")], total="t").collect()}
    assert got == {(1, "a", 3): (1, 2), (1, "a", 1): (2, 2), (1, "b", 2): (1, 1), (2, "a", 9): (1, 1)}
    assert with_positions(df.limit(0), ["x"], [F.col("z")]).count() == 0


@pytest.mark.parametrize("heavy_rows", [100, 200_000])
def test_by_key_light_and_heavy(spark, monkeypatch, heavy_rows):
    monkeypatch.setattr(positions, "HEAVY_ROWS", heavy_rows)
    df = entries(spark).repartition(5)
    order = [F.col("date").asc_nulls_last(), F.col("business_id")]
    got = with_positions_by_key(df, ["user_id"], order, "pos", "n")
    group = Window.partitionBy("user_id")
    want = df.withColumn("pos", F.row_number().over(group.orderBy(*order)).cast("long")).withColumn("n", F.count(F.lit(1)).over(group))
    assert got.columns == want.columns and dict(got.dtypes)["pos"] == "bigint"
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert with_positions_by_key(df.limit(0), ["user_id"], order).count() == 0


def test_ties_are_numbered_alike_twice(spark):
    df = spark.createDataFrame([("u", 1, float(i)) for i in range(50)], "user_id string, date int, stars double").repartition(7)
    got = with_positions_by_key(df, ["user_id"], [F.col("date")], "pos")
    assert [r.pos for r in got.orderBy("stars").collect()] == list(range(1, 51))


def test_rows_clustered_by_user_are_not_dealt_out_again(spark, no_broadcast):
    df = entries(spark).repartition(4, "user_id").persist()
    assert exchanges(profiles.user_history(df)) == [] == exchanges(profiles.user_events(df))
    got = hybrid.history_weights(df)
    assert exchanges(got) == []
    assert got.count() == df.count() and got.where("weight IS NULL").count() == 0
    df.unpersist()


def test_weights_of_rows_without_a_user(spark):
    rows = [(None, "a", 1.0, 1), (None, "b", None, 2), ("u", "a", 1.0, 1), ("u", "b", 1.0, 2), ("v", "a", 5.0, 1)]
    got = hybrid.history_weights(spark.createDataFrame(rows, "user_id string, business_id string, stars double, date int"))
    w = {(r.user_id, r.business_id): round(r.weight, 6) for r in got.collect()}
    # a sum of 0 leaves the recency alone
    assert w == {(None, "a"): 0.0, (None, "b"): 1.0, ("u", "a"): 0.846482, ("u", "b"): 1.0, ("v", "a"): 1.0}


def test_categories_are_cut_where_the_user_is(spark, no_broadcast, monkeypatch):
    hist = spark.createDataFrame([("u", "1", 1), ("u", "2", 2), ("v", "2", 1), (None, "1", 1)], "user_id string, business_id string, pos int")
    biz = spark.createDataFrame([("1", "x, y"), ("2", "y, z"), ("3", None)], "business_id string, categories string")
    light = profiles.user_top_categories(hist, biz, 2)
    assert not [e for e in exchanges(light) if "category" in e]
    monkeypatch.setattr(profiles, "HEAVY_ROWS", 2)
    heavy = profiles.user_top_categories(hist, biz, 2)
    want = {(None, "x", 1, 1), (None, "y", 1, 2), ("u", "y", 2, 1), ("u", "x", 1, 2), ("v", "y", 1, 1), ("v", "z", 1, 2)}
    assert {tuple(r) for r in light.collect()} == {tuple(r) for r in heavy.collect()} == want


def test_interactions_read_their_pairs_once(spark, no_broadcast):
    rows = [(f"u{u}", f"b{b}", 3.0, 1) for u in range(9) for b in range(12) if (u + b) % 4] * 2 + [("one", "b1", 1.0, 1), ("u1", "only", 1.0, 1)]
    got = prepare.build_interactions(spark.createDataFrame(rows, "user_id string, business_id string, stars double, date int"), 5, 5)
    assert "InMemoryTableScan" in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 81 and got.where("user_id = 'one' OR business_id = 'only'").count() == 0


def test_previous_rows_and_no_exchange_of_clustered_rows(spark, monkeypatch):
    rows = [(f"u{u}", i, f"b{(i * 7) % 50}") for u in range(5) for i in range(u * 10)] + [(None, 1, "x"), (None, 2, "y")]
    df = spark.createDataFrame(rows, "user_id string, day int, b string").repartition("user_id")
    want = sorted(((u or "", d, x, None if i == 0 else mine[i - 1][2]) for k in {r[0] for r in rows}
                   for mine in [sorted(r for r in rows if r[0] == k)] for i, (u, d, x) in enumerate(mine)), key=str)
    def got():
        out = positions.with_positions_by_key(df, ["user_id"], [F.col("day")], "pos", previous=("b", "before"))
        return out, sorted(((r["user_id"] or "", r["day"], r["b"], r["before"]) for r in out.collect()), key=str)
    out, found = got()
    assert found == want
    assert exchanges(out) == []
    monkeypatch.setattr(positions, "HEAVY_ROWS", 25)
    assert got()[1] == want
