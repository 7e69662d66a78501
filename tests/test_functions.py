import datetime as dt

import pytest
from pyspark.sql import functions as F

from tastegrid.functions import exprs
from tastegrid.operators import prepare


def _one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


@pytest.mark.parametrize("text,minute,expected", [
    ("9:0-17:0", 16 * 60 + 59, True), ("9:0-17:0", 17 * 60, False),
    ("18:0-2:0", 60, True), ("18:0-2:0", 12 * 60, False),
    ("0:0-0:0", 5, True), ("9:0-24:00", 23 * 60, True),
    ("9:0-24:30", 10 * 60, None), ("closed", 10 * 60, None), (None, 10 * 60, None),
])
def test_open_now(spark, text, minute, expected):
    got = _one(spark, exprs.open_now(F.col("h"), F.col("m")), [(text, minute)], "h string, m int")
    assert got == [expected]


def test_hour_token(spark):
    got = _one(spark, exprs.hour_token_minutes(F.col("t")), [("24:00",), ("24:01",), ("7:5",), ("x:1",), ("1:2:3",)], "t string")
    assert got == [1440, None, 425, None, None]


def test_attribute_text_keeps_null_value_key(spark):
    df = spark.createDataFrame([({"a": "1", "b": None},)], "m map<string,string>")
    assert df.select(exprs.attributes_text("m")).first()[0] == "a 1 b "


def test_wide_attribute_text_skips_none_like(spark):
    df = spark.createDataFrame([("yes", "None", " ", "NaN", "x")], "wifi string, park string, blank string, n string, o string")
    assert df.select(exprs.wide_attributes_text(df.columns)).first()[0] == "wifi yes o x"


def test_split_categories_and_clamp(spark):
    df = spark.createDataFrame([(" A, B ,, C ", 7.0), (None, -1.0)], "c string, s double")
    rows = df.select(exprs.split_categories("c"), exprs.clamp_rating("s")).collect()
    assert rows[0][0] == ["A", "B", "C"] and rows[0][1] == 5.0
    assert rows[1][0] == [] and rows[1][1] == 1.0


def test_alpha_values(spark):
    got = _one(spark, exprs.alpha_expr(F.col("n")), [(-5,), (0,), (12,), (100,)], "n int")
    assert got[0] == pytest.approx(1.0) and got[1] == pytest.approx(1.0)
    assert got[2] == pytest.approx(0.2 + 0.8 * 2.718281828 ** -1, abs=1e-6)
    assert got[3] == pytest.approx(0.2, abs=0.01)
    assert all(0.2 <= a <= 1.0 for a in got)


def test_activity_level_boundaries(spark):
    got = _one(spark, exprs.activity_level(F.col("n")), [(4,), (5,), (24,), (25,)], "n int")
    assert got == ["low", "medium", "medium", "high"]


def test_fixed_text_is_half_up(spark):
    got = _one(spark, exprs.fixed(F.col("x"), 2), [(3.125,), (4.0,), (0.004,)], "x double")
    assert got == ["3.13", "4.00", "0.00"]


def test_parse_ts_bad_is_null(spark):
    got = _one(spark, exprs.parse_ts(F.col("s")), [("2024-01-02 03:04:05",), ("not a date",)], "s string")
    assert got[0] == dt.datetime(2024, 1, 2, 3, 4, 5) and got[1] is None


def test_minmax_constant_column_gives_zero(spark):
    biz = spark.createDataFrame([("a", 3, 4.0), ("b", 3, 4.0)], "business_id string, review_count long, stars double")
    out = prepare.add_business_priors(biz).select("popularity_prior").collect()
    assert [r[0] for r in out] == [0.0, 0.0]


def test_empty_checkin_string_counts_zero(spark):
    biz = spark.createDataFrame([("a",), ("b",)], "business_id string")
    chk = spark.createDataFrame([("a", ""), ("a", "2024-01-01 10:00:00,2024-01-02 11:00:00"), ("b", "")], "business_id string, date string")
    got = {r[0]: r[1] for r in prepare.checkin_counts(chk, biz).collect()}
    assert got == {"a": 2.0, "b": 0.0}
