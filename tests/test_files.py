"""Raw-file loaders, caps in file order, tolerant log streams, model artefacts and chosen users."""

import json

import pytest
from pyspark.sql import functions as F

from tastegrid.operators import activity, prepare, profiles
from tastegrid.operators.ranking import top_k_of_global_order
from tastegrid.sources import files
from tastegrid.streaming import streams


def test_attributes_of_any_type(spark, tmp_path):
    values = {"m": {"z": "1", "a": None, "b": True}, "t": "plain text", "n": 3.5, "i": 7, "l": [1, "x"], "o": None, "f": False, "e": {}, "q": '{"not": "an object"}'}
    lines = [json.dumps({"business_id": k, "name": "N", "review_count": 3, "attributes": v, "hours": {"Monday": "9:0-17:0", "Friday": " ", "Sunday": None} if k == "m" else v})
             for k, v in values.items()] + ["", "{broken", "[1]", json.dumps({"business_id": "none"})]
    (tmp_path / "b.json").write_text("\n".join(lines))
    df = files.read_business_lines(spark, str(tmp_path / "b.json"))
    got = {r["business_id"]: r["attributes"] for r in df.collect()}
    assert got == {"m": "z 1 a  b true", "t": "plain text", "n": "3.5", "i": "7", "l": '[1,"x"]', "o": "", "f": "false", "e": "", "q": '{"not": "an object"}', "none": ""}
    assert sorted(map(tuple, files.hours_from_map(df).collect())) == [("m", "Monday", "9:0-17:0")]


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_caps_in_file_order(spark, tmp_path, fmt):
    # three files; every third row is of a selected business
    rows = [(f"u{i:04d}", f"b{i % 3}", 4.0, f"2024-01-{1 + i % 28:02d}", "t") for i in range(900)]
    df = spark.createDataFrame(rows, "user_id string, business_id string, stars double, date string, text string")
    df.repartitionByRange(3, "user_id").sortWithinPartitions("user_id").write.format(fmt).save(f"{tmp_path}/reviews.{fmt}")
    biz = spark.createDataFrame([("b0",)], "business_id string")
    for chunks in (1, 7, 40):
        got = sorted(r["user_id"] for r in files.load_reviews(spark, str(tmp_path), biz, fmt, False, 50, chunks).collect())
        mine = [r[0] for r in rows if r[1] == "b0"]
        want = [r[0] for r in rows[:50 * chunks] if r[1] == "b0"] if fmt == "json" else mine[:50 * chunks]
        assert got == want
    whole = files.load_reviews(spark, str(tmp_path), biz, fmt, True)
    assert whole.count() == 300 and whole.columns[-1] == "text" and whole.schema["date"].dataType.typeName() == "timestamp"


def test_log_stream_keeps_bad_lines_aside(spark, tmp_path):
    path = str(tmp_path / "log")
    files.append_log(spark.createDataFrame([("u", "b", 9.0, "2024-01-02 03:04:05")], "user_id string, business_id string, stars double, date string"), path)
    files.append_interactions(spark, path, [{"user_id": "u", "business_id": "c", "stars": 0.0}])
    with open(f"{path}/more.json", "w") as fh:
        fh.write('{"user_id": "v", "business_id": "d", "stars": 3.0, "date": "garbage"}\n\n{not json\n{"user_id": "w", "stars": "many"}\n')
    rows, bad = streams.run_log(files.log_stream(spark, path), "t")
    got = {r["business_id"]: (r["stars"], r["source"]) for r in rows.collect()}
    assert got == {"b": (5.0, "local"), "c": (1.0, "local"), "d": (3.0, None)}
    assert sorted(r["bad"] for r in bad.collect()) == ['{"user_id": "w", "stars": "many"}', "{not json"]
    checked = {r["business_id"]: r["date"] for r in prepare.local_log_rows(rows).collect()}
    assert checked["d"] is None and str(checked["b"]) == "2024-01-02 03:04:05"


def test_a_partial_model_is_refused(spark, tmp_path):
    part = spark.createDataFrame([("b", 0.5), ("c", 0.1)], "business_id string, bias double")
    files.save_model({"item_bias": part, "seen": part}, str(tmp_path / "m"), {"n_businesses": 2})
    assert set(files.load_model(spark, str(tmp_path / "m"))) == {"item_bias", "seen"}
    summary = {(r["kind"], r["name"]): r["value"] for r in files.model_summary(spark, str(tmp_path / "m")).collect()}
    assert summary == {("part", "item_bias"): 2, ("part", "seen"): 2, ("summary", "n_businesses"): 2}
    part.limit(1).write.mode("overwrite").parquet(str(tmp_path / "m" / "seen"))
    with pytest.raises(ValueError):
        files.load_model(spark, str(tmp_path / "m"))
    part.write.parquet(str(tmp_path / "half" / "item_bias"))
    with pytest.raises(FileNotFoundError):
        files.load_model(spark, str(tmp_path / "half"))

    class Broken(Exception):
        pass

    def fail(x):
        raise Broken
    bad = spark.range(1).select(F.udf(fail, "double")("id").alias("bias"))
    with pytest.raises(Exception):  # noqa: B017
        files.save_model({"item_bias": part, "seen": bad}, str(tmp_path / "m"))
    with pytest.raises(FileNotFoundError):  # the earlier manifest went first
        files.load_model(spark, str(tmp_path / "m"))


def test_prior_source_is_chosen_in_the_plan(spark):
    biz = spark.createDataFrame([("a", 10, 4.0, None), ("b", 20, 3.0, None)], "business_id string, review_count bigint, stars double, popularity_prior double")
    tips = spark.createDataFrame([("a",), ("a",), ("b",)], "business_id string")
    look = spark.createDataFrame([("b", "2024-01-01, 2024-01-02")], "business_id string, date string")
    run = lambda df: {r["business_id"]: (r["prior_source"], r["popularity_prior"]) for r in prepare.with_prior(df, tips, look).collect()}
    scan = run(biz)
    assert {v[0] for v in scan.values()} == {"scan"} and all(v[1] is not None for v in scan.values())
    assert run(biz.drop("popularity_prior")) == scan
    counted = biz.withColumns({"tip_count": F.when(F.col("business_id") == "a", 2.0).otherwise(1.0), "checkin_count": F.when(F.col("business_id") == "b", 2.0)})
    assert run(counted) == {b: ("counts", pytest.approx(v[1])) for b, v in scan.items()}
    stored = counted.withColumn("popularity_prior", F.when(F.col("business_id") == "b", 0.3))
    assert run(stored) == {"a": ("stored", None), "b": ("stored", 0.3)}


def test_chosen_users_open_their_folders_only(spark, tmp_path):
    rows = [(f"u{i % 200}", f"b{i}", 4.0, f"2024-01-{1 + i % 28:02d}") for i in range(2_000)]
    df = spark.createDataFrame(rows, "user_id string, business_id string, stars double, date string")
    activity.write_events_by_user(df, str(tmp_path / "e"))
    chosen = df.where("user_id IN ('u3', 'u7')").select("user_id")
    out = activity.events_of_users(spark.read.parquet(str(tmp_path / "e")), chosen)
    assert sorted(r["business_id"] for r in out.collect()) == sorted(b for u, b, *_ in rows if u in ("u3", "u7"))
    assert "dynamicpruning" in out._jdf.queryExecution().toString().lower()
    assert {r[0] for r in activity.demo_ready_users(df.limit(0), df).collect()} == {f"u{i}" for i in range(200)}
    assert {r[0] for r in activity.demo_ready_users(chosen, df).collect()} == {"u3", "u7"}


def test_account_columns_decide(spark):
    mine = spark.createDataFrame([("u1", "me", 3, 9), ("u2", "you", 4, 8)], "user_id string, name string, review_count int, interaction_count int")
    acct = spark.createDataFrame([("u1", None, 70, 4.5, "a,b", "  ", 1, 5), ("u3", "x", 1, 1.0, "", "", 0, 0)],
                                 "user_id string, name string, review_count int, average_stars double, friends string, elite string, elite_year_count int, useful int")
    rows = profiles.account_rows(acct.withColumn("yelping_since", F.lit("2020-05-06 07:08:09").cast("timestamp")), mine)
    assert "friends" not in rows.columns and [r["user_id"] for r in rows.collect()] == ["u1"] and rows.first()["yelping_since"] == "2020-05-06"
    got = {r["user_id"]: r for r in profiles.compose_whole_profile(mine, rows).collect()}
    assert got["u1"]["name"] is None and got["u1"]["review_count"] == 3 and got["u1"]["review_count_profile"] == 70 and got["u1"]["useful_votes"] == 5
    assert got["u1"]["user_tier"] == "elite" and got["u2"]["user_tier"] == "regular" and got["u2"]["name"] == "you" and got["u2"]["average_stars"] is None


def test_fallback_of_a_heavy_user_in_two_rounds(spark, monkeypatch):
    from tastegrid.operators import ranking
    monkeypatch.setattr(ranking, "SLOTS", 7)
    items = spark.createDataFrame([(f"i{j:03d}", float(100 - j // 2)) for j in range(120)], "business_id string, score double")
    users = spark.createDataFrame([("all",), ("most",), ("few",), ("none",), ("head",)], "user_id string")
    own = {"all": range(120), "most": range(118), "few": (1, 2, 3), "head": range(20)}
    ex = spark.createDataFrame([(u, f"i{j:03d}") for u, js in own.items() for j in js] + [("few", "i001"), ("few", "unknown")], "user_id string, business_id string")
    got = {}
    for r in top_k_of_global_order(users, items, ex, 5).collect():
        got.setdefault(r["user_id"], []).append((r["rank"], r["business_id"]))
    want = {u: [f"i{j:03d}" for j in range(120) if j not in set(own.get(u, ()))][:5] for u in ("all", "most", "few", "none", "head")}
    assert {u: [b for _, b in sorted(v)] for u, v in got.items()} == {u: v for u, v in want.items() if v}
    assert sorted(got["most"]) == [(1, "i118"), (2, "i119")]


def test_raw_reviews_are_dealt_out_once(spark, monkeypatch, tmp_path):
    """Both formats come from one sorted table; without an order nothing is sorted."""
    from tastegrid.plans import q_files
    from tastegrid.plans.context import Ctx
    c = Ctx(spark, str(tmp_path))
    c.review = spark.createDataFrame([(f"u{i % 7}", f"b{i % 5}", 3.0, None) for i in range(40)], "user_id string, business_id string, stars double, date timestamp_ntz")
    assert "RepartitionByExpression" not in q_files.raw_reviews(c, False)._jdf.queryExecution().optimizedPlan().toString()
    made = []
    real = q_files.raw_reviews
    monkeypatch.setattr(q_files, "raw_reviews", lambda *a: made.append(a) or real(*a))
    monkeypatch.setattr(q_files.catalog, "raw_businesses", lambda *a: spark.createDataFrame([("{}",)], "value string"))
    monkeypatch.setattr(q_files.catalog, "wide_attributes", lambda *a: c.review)
    c.business = c.review
    out = q_files.raw_folder(c, ("json", "parquet"))
    assert len(made) == 1
    assert spark.read.json(f"{out}/reviews.json").count() == spark.read.parquet(f"{out}/reviews.parquet").count() == 40


def test_ordered_reviews_move_no_text_and_lines_are_compressed(spark, tmp_path, monkeypatch):
    import datetime as dt
    import types

    from tastegrid.plans import q_files

    review = spark.createDataFrame([(f"u{i % 7}", f"b{i % 5}", float(i % 5), dt.datetime(2024, 1, 1 + i % 20)) for i in range(60)],
                                   "user_id string, business_id string, stars double, date timestamp_ntz")
    rows = q_files.raw_reviews(types.SimpleNamespace(review=review))
    exchange = next(x for x in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression" in x)
    assert "text" not in exchange
    got = [tuple(r) for r in rows.collect()]
    assert got == sorted(got) and all(r[4] == f"stars {int(r[2])} for {r[1]}" for r in got) and len(got) == 60
    biz = spark.createDataFrame([("b1",)], "business_id string")
    c = types.SimpleNamespace(review=review, spark=spark, sf_dir="", business=biz)
    monkeypatch.setattr(q_files, "_folder", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(q_files.catalog, "raw_businesses", lambda *a: spark.createDataFrame([("{}",)], "value string"))
    base = q_files.raw_folder(c, ("json",))
    assert list((tmp_path / "raw" / "reviews.json").glob("*.json.gz")) and not list((tmp_path / "raw" / "reviews.json").glob("*.json"))
    kept = q_files.files.load_reviews(spark, base, biz, "json", True, 10, 2)
    assert sorted((r["user_id"], r["business_id"], r["stars"]) for r in kept.collect()) == sorted(r[:3] for r in got[:20] if r[1] == "b1")
