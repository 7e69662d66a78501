"""The driver's TPC-H-like tables seen as the recommender's tables.

Each function returns a lazily evaluated DataFrame with the column names
and types the operators expect.  The same mapping is written once more as
SQL in ``tastegrid.plans.sql_views`` for the DuckDB oracle.

=================  ==========================================================
review             lineitem x orders: user = o_custkey, business = l_partkey,
                   stars = least(5, 1 + floor((l_quantity - 1) / 10)),
                   date = o_orderdate
business           part: name = p_name, categories = "p_type, p_brand",
                   attributes = map(size, type), review stats from review
account profile    customer
tip                events of type click, business = props.k
check-in           events of type view, one row per (business, day) with a
                   comma list of timestamps
request event      all events (algorithm = event_type, latency_ms = value)
local interaction  events of type purchase, stars = clamp(value / 20)
given factors      embeddings: item p -> vector p % n, user c -> vector c % n
=================  ==========================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid import constants as K
from tastegrid.functions.exprs import attributes_text, clamp_rating, json_key, soup_expr
from tastegrid.sources.tables import read_table


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole numbers before the join: they take less room in its exchange
    stars = F.least(F.lit(5.0), F.lit(1.0) + F.floor((F.col("l_quantity") - 1) / 10)).cast("long").alias("stars")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", stars)
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").cast("string").alias("user_id"),
                    F.col("l_partkey").cast("string").alias("business_id"),
                    F.col("stars").cast("double").alias("stars"),
                    F.col("o_orderdate").alias("date")))


def business_stats(review: DataFrame) -> DataFrame:
    """review_count and mean stars per business (partial aggregation before the shuffle)."""
    return review.groupBy("business_id").agg(F.count(F.lit(1)).alias("review_count"),
                                             F.avg("stars").alias("stars"))


def business_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows before review statistics."""
    p = read_table(spark, sf_dir, "part")
    bid = F.col("p_partkey").cast("string")
    null_geo = (F.col("p_partkey") % 10) == 0
    return p.select(
        bid.alias("business_id"),
        F.col("p_name").alias("name"),
        F.lit(None).cast("string").alias("city"),
        F.lit(None).cast("string").alias("state"),
        F.concat(F.col("p_size").cast("string"), F.lit(" Main St")).alias("address"),
        F.when(~null_geo, F.lit(40.0) + F.col("p_size") / 100.0).alias("latitude"),
        F.when(~null_geo, F.lit(-74.0) - F.col("p_size") / 100.0).alias("longitude"),
        F.lit(1).alias("is_open"),
        F.concat(F.col("p_type"), F.lit(", "), F.col("p_brand")).alias("categories"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type")).alias("attributes"),
    )


def businesses(spark: SparkSession, sf_dir: str, review: DataFrame | None = None) -> DataFrame:
    """Business table with review statistics and the P5 text profile ("soup")."""
    review = review if review is not None else reviews(spark, sf_dir)
    stats = business_stats(review)
    base = business_base(spark, sf_dir)
    out = (base.join(stats, "business_id", "left")
           .withColumn("review_count", F.coalesce(F.col("review_count"), F.lit(0)).cast("long"))
           .withColumn("attributes", attributes_text("attributes")))
    return out.withColumn("soup", soup_expr(F.col("name"), F.col("categories"), F.col("attributes")))


def wide_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide attribute side table: one column per attribute (P7 input)."""
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("business_id"),
                    F.col("p_brand").alias("brand"),
                    F.col("p_size").cast("string").alias("size"),
                    F.col("p_type").alias("type"))


def soup_side_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precomputed soup side table (J2 input): document text keyed like the catalogue."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("business_id"), F.col("text").alias("soup"))


def opening_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide opening-hours table: one column per weekday, null when closed that day."""
    p = read_table(spark, sf_dir, "part")
    text = F.concat((F.col("p_size") % 24).cast("string"), F.lit(":0-"),
                    ((F.col("p_size") * 7) % 24).cast("string"), F.lit(":0"))
    cols = [F.when((F.col("p_partkey") % 7) == i, text).alias(day) for i, day in enumerate(K.WEEKDAYS)]
    return p.select(F.col("p_partkey").cast("string").alias("business_id"), *cols)


def account_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("user_id"),
                    F.col("c_name").alias("name"),
                    F.col("c_acctbal").alias("average_stars"),
                    F.col("c_mktsegment").alias("elite"),
                    F.lit(None).cast("long").alias("elite_year_count"),
                    F.col("c_nationkey").cast("long").alias("fans"))


def tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return (e.filter(F.col("event_type") == "click")
            .select(json_key("props", "k").alias("business_id"), F.col("ts").alias("date")))


def checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (business, day) holding a comma list of timestamps, like the raw check-in file."""
    e = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    return (e.select(json_key("props", "k").alias("business_id"), F.col("ts"))
            .groupBy("business_id", F.to_date("ts").alias("day"))
            .agg(F.concat_ws(",", F.collect_list(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).alias("date"))
            .select("business_id", "date"))


def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("ts"), F.col("user_id").cast("string").alias("user_id"),
                    F.col("event_type").alias("algorithm"), F.lit(10).alias("k"),
                    F.col("value").alias("latency_ms"), F.lit("api").alias("source"))


def local_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return e.select(F.col("user_id").cast("string").alias("user_id"),
                    json_key("props", "k").alias("business_id"),
                    clamp_rating(F.col("value") / 20.0).alias("stars"),
                    F.col("ts").alias("date"),
                    F.lit("local").alias("source"))


def given_item_factors(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    """Fixed item factors: business id p -> embedding p % n (n = embedding rows)."""
    return _given_factors(spark, sf_dir, items, "business_id")


def given_user_factors(spark: SparkSession, sf_dir: str, users: DataFrame) -> DataFrame:
    """Fixed user factors: user id c -> embedding c % n."""
    return _given_factors(spark, sf_dir, users, "user_id")


def _given_factors(spark, sf_dir, keys: DataFrame, key: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    n = emb.select(F.count(F.lit(1))).scalar()
    vecs = emb.select(F.col("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("factors"))
    # The embedding table is a fixed-size lookup (rows = n); the join is an equi join on vec_id.
    k = keys.select(key).distinct().withColumn("vec_id", F.pmod(F.col(key).cast("long"), n))
    return k.join(vecs, "vec_id").select(key, "factors")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole account table: customers with counts of their orders; a friends column that readers must not load."""
    c, o = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    votes = {name: F.count(F.when(F.col("o_orderstatus") == status, 1)).alias(name) for name, status in (("useful", "O"), ("funny", "F"), ("cool", "P"))}
    per = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("yelping_since"), F.count(F.lit(1)).alias("review_count"), *votes.values())
    n = F.col("c_custkey")
    counters = [F.pmod(n * (i + 2), F.lit(7)).alias(name) for i, name in enumerate(x for x in K.ACCOUNT_COLUMNS if x.startswith("compliment_"))]
    rows = c.join(per, c["c_custkey"] == per["o_custkey"], "left")
    return rows.select(n.cast("string").alias("user_id"), F.col("c_name").alias("name"), "yelping_since", "review_count", F.col("c_acctbal").alias("average_stars"),
                       "useful", "funny", "cool", F.col("c_nationkey").cast("long").alias("fans"),
                       F.when(n % 3 == 0, F.col("c_mktsegment")).otherwise(F.lit(" ")).alias("elite"), F.pmod(n, F.lit(4)).alias("elite_year_count"),
                       F.concat_ws(",", n - 1, n + 1).alias("friends"), F.pmod(n, F.lit(50)).alias("friends_count"), *counters)


def raw_businesses(spark: SparkSession, sf_dir: str, review: DataFrame) -> DataFrame:
    """JSON lines of the businesses, with attributes that are an object, text, a number or null, and hours that may lack."""
    p = read_table(spark, sf_dir, "part")
    b = businesses(spark, sf_dir, review).select("business_id", "name", "address", "latitude", "longitude", "stars", "review_count", "is_open", "categories")
    key = F.col("p_partkey")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    attributes = (F.when(key % 4 == 0, F.concat(F.lit('{"type": "'), F.col("p_type"), F.lit('", "size": '), F.col("p_size").cast("string"), F.lit(', "open": null}')))
                  .when(key % 4 == 1, quoted(F.col("p_type"))).when(key % 4 == 2, F.col("p_size").cast("string")).otherwise(F.lit("null")))
    text = F.concat((F.col("p_size") % 24).cast("string"), F.lit(":0-"), ((F.col("p_size") * 7) % 24).cast("string"), F.lit(":0"))
    hours = F.when(key % 5 == 0, F.lit("null")).otherwise(F.concat(
        F.lit('{"Monday": '), quoted(text), F.lit(', "Friday": '), F.when(key % 3 == 0, F.lit('" "')).otherwise(quoted(text)), F.lit(', "Sunday": null}')))
    plain = F.to_json(F.struct("business_id", "name", "address", F.col("p_brand").alias("city"), F.lit("OH").alias("state"), "latitude", "longitude", "stars",
                               "review_count", "is_open", "categories"))
    line = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.lit(', "attributes": '), attributes, F.lit(', "hours": '), hours, F.lit("}"))
    return b.join(p.select("p_partkey", "p_brand", "p_type", "p_size"), F.col("business_id") == key.cast("string")).select(line.alias("value"))
