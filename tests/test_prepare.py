import datetime as dt

from pyspark.sql import functions as F

from tastegrid.operators import prepare


def test_thresholds_counted_once(spark):
    # u3 has 3 items, but one item (x) has too few users; u3 keeps 2 rows (one pass, not a k-core)
    rows = [(u, i, 4.0, dt.datetime(2024, 1, 1)) for u in ("u1", "u2", "u3") for i in ("a", "b")]
    rows += [("u3", "x", 5.0, dt.datetime(2024, 1, 2))]
    rows += [("u1", "c", 3.0, dt.datetime(2024, 1, 3))]
    rev = spark.createDataFrame(rows, "user_id string, business_id string, stars double, date timestamp_ntz")
    out = prepare.build_interactions(rev, min_user_reviews=3, min_item_reviews=3)
    got = sorted((r.user_id, r.business_id) for r in out.collect())
    assert got == [("u1", "a"), ("u1", "b"), ("u3", "a"), ("u3", "b")]


def test_pairs_average_and_latest_date(spark):
    rows = [("u", "a", 2.0, dt.datetime(2024, 1, 1)), ("u", "a", 4.0, dt.datetime(2024, 2, 1))]
    rev = spark.createDataFrame(rows, "user_id string, business_id string, stars double, date timestamp_ntz")
    r = prepare.build_interactions(rev, 1, 1).first()
    assert r.stars == 3.0 and r.date == dt.datetime(2024, 2, 1)


def test_business_filters_and_soup(spark):
    biz = spark.createDataFrame(
        [("1", "A", "Pizza, Restaurants", 12, "AZ"), ("2", "B", "Bars", 30, "AZ"), ("3", "C", None, 50, "ON"),
         ("4", "D", "restaurants", 9, "AZ"), ("5", "E", "Restaurants", None, "NV")],
        "business_id string, name string, categories string, review_count long, state string")
    out = prepare.filter_businesses(biz, 10, "Restaurants", usa_only=True)
    assert sorted(r.business_id for r in out.collect()) == ["1"]
    side = prepare.attach_side_tables(biz.withColumn("attributes", F.lit("")).withColumn("soup", F.lit("")),
                                      None, None, None)
    soups = {r.business_id: r.soup for r in side.collect()}
    assert soups["1"] == "a pizza, restaurants " and soups["3"] == "c  "


def test_soup_backfill_keeps_given_soup(spark):
    biz = spark.createDataFrame([("1", "Name", "Cat")], "business_id string, name string, categories string")
    soup = spark.createDataFrame([("1", "  given text ")], "business_id string, soup string")
    out = prepare.attach_side_tables(biz, None, soup, None).first()
    assert out.soup == "  given text "


def test_merge_modes(spark, interactions):
    local = spark.createDataFrame([("u9", "b01", 5.0, dt.datetime(2024, 5, 1), "local")],
                                  "user_id string, business_id string, stars double, date timestamp_ntz, source string")
    assert prepare.merge_datasets(interactions, local, "merged").count() == 15
    assert prepare.merge_datasets(interactions, local, "local_only").count() == 1
