from pyspark.sql import functions as F

from tastegrid.llm import revisits as rv

SCHEMA = "record_id bigint, url string, time bigint, kind string, headers map<string,string>, outcome string"


def resolved(spark, rows):
    got = rv.resolve(spark.createDataFrame([(*r, "old") for r in rows], SCHEMA)).collect()
    return {r["record_id"]: (r["response_id"], r["outcome"], r["merged"]) for r in got}


def test_outcomes(spark):
    rows = [
        (1, "http://www.A.com:80/x/?b=2&a=1&utm_source=q#f", 10, "response", {"ETag": 'W/"v1"', "Content-Type": "t", "Content-Length": "9", "Age": "1"}),
        (2, "https://a.com/x?a=1&b=2", 20, "response", {"ETag": '"v2"', "Last-Modified": "m"}),
        (3, "http://a.com/x?b=2&a=1", 15, "revisit", {"etag": '"v1"', "Content-Length": "0", "Age": "7", "Connection": "Hop", "Hop": "h"}),
        (4, "http://a.com/x?b=2&a=1", 25, "revisit", {"ETAG": '"v1"'}),
        (5, "http://a.com/x?b=2&a=1", 25, "revisit", {"Last-Modified": "m", "X-New": "n"}),
        (6, "http://a.com/x?b=2&a=1", 25, "revisit", {"Date": "d"}),
        (7, "http://a.com/x?b=2&a=1", 10, "revisit", {"ETag": '"v1"'}),
        (8, None, 30, "revisit", {"ETag": '"v1"'}),
        (9, "http://a.com/x?b=2&a=1", None, "revisit", {"ETag": '"v1"'}),
        (10, "http://a.com/y", 5, "response", None), (11, "http://a.com/y", 6, "revisit", None), (12, "http://a.com/y", 6, "revisit", {"ETag": "e"}),
        (13, "http://a.com/x?a=1&b=2", 20, "response", {"ETag": '"v3"'}), (14, "http://a.com/x?a=1&b=2", 21, "revisit", {"ETag": '"v3"', "etag": '"v3"'}),
        (15, "http://a.com/y", 7, "metadata", None)]
    got = resolved(spark, rows)
    assert got[3] == (1, "resolved", {"etag": '"v1"', "content-type": "t", "content-length": "9", "age": "7"})
    assert got[4][:2] == (None, "mismatch") and got[5][:2] == (None, "mismatch")
    assert got[6][1] == got[11][1] == "no_validator" and got[12][1] == "mismatch"
    assert got[7][1] == got[8][1] == got[9][1] == "no_response"
    assert got[14][:2] == (13, "resolved") and 15 not in got and len(got) == 10


def test_equals_brute_force_over_many_blocks(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for i in range(1_500):
        u = "http://hot.net/" if rnd.random() < 0.4 else f"http://h{rnd.randrange(60)}.net/"
        rows.append((i, u, rnd.randrange(400), rnd.choice(["response", "revisit"]), {"ETag": str(rnd.randrange(2))}))
    got = resolved(spark, rows)
    for i, u, t, kind, h in rows:
        if kind == "revisit":
            before = [(r[2], r[0], r[4]) for r in rows if r[3] == "response" and r[1] == u and r[2] < t]
            if not before:
                want = (None, "no_response")
            else:
                last = max(before, key=lambda x: x[:2])
                want = (last[1], "resolved") if last[2] == h else (None, "mismatch")
            assert got[i][:2] == want


def test_empty_and_repeated(spark):
    assert resolved(spark, []) == {}
    row = (2, "http://a.b/", 2, "revisit", {"ETag": "x"})
    df = spark.createDataFrame([(*r, "old") for r in [(1, "http://a.b/", 1, "response", {"ETag": "x"}), row, row]], SCHEMA)
    assert [r["response_id"] for r in rv.resolve(df).collect()] == [1, 1]
    null = spark.range(3).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    assert {r["outcome"] for r in rv.resolve(rv.page_records(null)).collect()} == {"no_response"}
