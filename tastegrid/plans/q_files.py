"""Jobs that start from raw files: loaders, preparation under one config, artefacts and chosen users
(S1-S7, S10, S12, S16-S18, P4, P6, P18, A7, J15, J16, W8, W11, W12).

The raw files are written from the driver's tables to the shared folder first, in a known order of rows.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import functions as F

from tastegrid import constants as K
from tastegrid.functions.exprs import round6, soup_expr
from tastegrid.operators import activity, evaluate, hybrid, prepare, profiles
from tastegrid.plans.context import Ctx, written_reviews
from tastegrid.plans.q_eval import split_parts
from tastegrid.plans.q_hybrid import given_inputs
from tastegrid.plans.registry import query
from tastegrid.plans.sql_views import _NORM, with_views
from tastegrid.session import ensure_checkpoint_dir
from tastegrid.sources import catalog, files

CHUNK, CHUNKS = 2_000, 4
CITY = "Brand#1"
_ORDER = ("user_id", "business_id", "stars", "date", "text")


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def raw_reviews(c: Ctx, ordered: bool = True):
    """Reviews with a text, in the order in which they are written."""
    rows = c.review
    if ordered:
        # the text follows from other columns: it orders nothing and need not be moved
        rows = rows.repartitionByRange(*_ORDER[:-1]).sortWithinPartitions(*_ORDER[:-1])
    text = F.concat(F.lit("stars "), F.col("stars").cast("int").cast("string"), F.lit(" for "), "business_id")
    return rows.withColumn("text", text).select(*_ORDER)


def raw_folder(c: Ctx, formats: tuple[str, ...], ordered: bool = True) -> str:
    """Raw files of the asked formats, with the names that the loaders look for; reviews in no order where none is asked for."""
    out = _folder(c.spark, "raw")
    # dealt out and sorted once for all formats
    reviews = raw_reviews(c).persist(StorageLevel.MEMORY_AND_DISK) if ordered and len(formats) > 1 else raw_reviews(c, ordered)
    if "json" in formats:
        catalog.raw_businesses(c.spark, c.sf_dir, c.review).write.text(f"{out}/business.json")
        reviews.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss")).write.option("compression", "gzip").json(f"{out}/reviews.json")
    if "parquet" in formats:
        c.business.write.parquet(f"{out}/business_main.parquet")
        catalog.wide_attributes(c.spark, c.sf_dir).write.parquet(f"{out}/business_attributes.parquet")
        reviews.write.parquet(f"{out}/reviews.parquet")
    reviews.unpersist()
    return out


def load_businesses(spark, data_dir: str, source_format: str = "auto", **filters):
    """S7 from files: S1 or S2 by S3, then filters, column selection and one row a business."""
    if files.resolve_source_format(spark, source_format, data_dir) == "json":
        rows = files.read_business_lines(spark, f"{data_dir}/business.json")
        rows = rows.withColumn("soup", soup_expr(F.col("name"), F.col("categories"), F.col("attributes")))
    else:
        parts = files.read_business_parquet(spark, data_dir)
        rows = prepare.attach_side_tables(parts["main"], parts["attributes"], parts["soup"], parts["popularity"])
    return prepare.load_businesses(rows, **filters)


def run_preparation(spark, data_dir: str, config: dict):
    """Businesses, reviews and interactions from raw files under one config; (businesses, reviews, interactions)."""
    fmt = config.get("source_format", "auto")
    filters = {k: config[k] for k in ("min_reviews", "category_keyword", "usa_only", "city", "state") if k in config}
    biz = load_businesses(spark, data_dir, fmt, **filters)
    reviews = files.load_reviews(spark, data_dir, biz, fmt, config.get("include_text", False), config.get("chunksize", 200_000), config.get("max_chunks"))
    pairs = prepare.build_interactions(reviews, config.get("min_user_reviews", K.MIN_USER_REVIEWS), config.get("min_item_reviews", K.MIN_ITEM_REVIEWS))
    return biz, reviews, pairs


_RAW = """
raw AS (
  SELECT CAST(p_partkey AS VARCHAR) AS business_id, p_name AS name, p_brand AS city, p_type || ', ' || p_brand AS categories,
         CASE p_partkey % 4 WHEN 0 THEN 'type ' || p_type || ' size ' || p_size || ' open ' WHEN 1 THEN p_type WHEN 2 THEN CAST(p_size AS VARCHAR) ELSE '' END AS attributes,
         p_partkey, CAST(p_size % 24 AS VARCHAR) || ':0-' || CAST((p_size * 7) % 24 AS VARCHAR) || ':0' AS hours
  FROM part)"""


def _raw_sql(body: str, *names: str) -> str:
    sql = with_views(body, *names)
    return sql.replace("WITH ", f"WITH {_RAW.strip()}, ", 1)


@query("businesses_from_json", "S1, S7, P4, P6", _raw_sql(f"""
SELECT r.business_id, r.name, r.city, r.attributes, lower(r.name || ' ' || r.categories || ' ' || r.attributes) AS soup, b.review_count
FROM raw r JOIN bstats b ON b.business_id = r.business_id
WHERE b.review_count >= {K.MIN_BUSINESS_REVIEWS} AND lower(r.city) = lower('{CITY}')""", "bstats"))
def businesses_from_json(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    out = load_businesses(spark, raw_folder(c, ("json",)), min_reviews=K.MIN_BUSINESS_REVIEWS, category_keyword=None, city=CITY.upper(), state="oh")
    return out.select("business_id", "name", "city", "attributes", "soup", "review_count")


@query("hours_from_json", "S10", """
SELECT CAST(p_partkey AS VARCHAR) AS business_id, day, CAST(p_size % 24 AS VARCHAR) || ':0-' || CAST((p_size * 7) % 24 AS VARCHAR) || ':0' AS hours
FROM part, (VALUES ('Monday'), ('Friday')) d(day)
WHERE p_partkey % 5 <> 0 AND NOT (day = 'Friday' AND p_partkey % 3 = 0)""")
def hours_from_json(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return files.hours_from_map(files.read_business_lines(spark, f"{raw_folder(c, ('json',))}/business.json"))


_TEXT_REVIEW = """SELECT *, 'stars ' || CAST(CAST(stars AS INT) AS VARCHAR) || ' for ' || business_id AS text FROM review"""


@query("reviews_capped", "S4, S5, S6, P11, P12", with_views(f"""
SELECT 'json' AS source, user_id, business_id, stars, date, text
FROM (SELECT * FROM ({_TEXT_REVIEW}) ORDER BY {", ".join(_ORDER)} LIMIT {CHUNK * CHUNKS})
WHERE business_id IN (SELECT business_id FROM catalogue WHERE categories ILIKE '%brand#1%')
UNION ALL
SELECT 'parquet', * FROM (
  SELECT {", ".join(_ORDER)} FROM ({_TEXT_REVIEW}) WHERE business_id IN (SELECT business_id FROM catalogue WHERE categories ILIKE '%brand#1%')
  ORDER BY {", ".join(_ORDER)} LIMIT {CHUNK * CHUNKS})""", "review", "catalogue"))
def reviews_capped(spark, sf_dir):
    c = written_reviews(Ctx(spark, sf_dir))
    base = raw_folder(c, ("json", "parquet"))
    biz = prepare.filter_businesses(c.business, K.MIN_BUSINESS_REVIEWS, "brand#1")
    out = None
    for fmt in ("json", "parquet"):  # JSON caps the rows read, Parquet the rows kept
        rows = files.load_reviews(spark, base, biz, fmt, True, CHUNK, CHUNKS)
        rows = rows.select(F.lit(fmt).alias("source"), "user_id", "business_id", "stars", F.col("date").cast("timestamp_ntz").alias("date"), "text")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("interactions_from_files", "S2, S3, S6, S7, S18, A1, A2", with_views(
    "SELECT user_id, business_id, ROUND(stars, 6) AS stars, date FROM interactions", "interactions"))
def interactions_from_files(spark, sf_dir):
    c = written_reviews(Ctx(spark, sf_dir))
    config = {"source_format": "auto", "min_reviews": K.MIN_BUSINESS_REVIEWS, "category_keyword": None}
    _, _, pairs = run_preparation(spark, raw_folder(c, ("json", "parquet"), ordered=False), config)
    return pairs.select("user_id", "business_id", round6("stars").alias("stars"), "date")


def _prior_sql(name: str, tips: str, checkins: str) -> str:
    return f"""
{name}_f AS (SELECT business_id, ln(1 + COALESCE(CAST(review_count AS DOUBLE), 0.0)) AS f_rev, COALESCE(stars, 0.0) AS f_star,
               ln(1 + {tips}) AS f_tip, ln(1 + {checkins}) AS f_chk FROM catalogue),
{name} AS (SELECT business_id, CAST({K.PRIOR_W_REVIEWS} * {_NORM.format(c='f_rev')} + {K.PRIOR_W_STARS} * {_NORM.format(c='f_star')}
             + {K.PRIOR_W_TIPS} * {_NORM.format(c='f_tip')} + {K.PRIOR_W_CHECKINS} * {_NORM.format(c='f_chk')} AS DOUBLE) AS popularity_prior FROM {name}_f)"""


@query("prior_source", "A7, A5, A6", with_views(f"""
SELECT 'stored' AS prior_source, business_id, CASE WHEN review_count % 2 = 0 THEN ROUND(review_count / 100.0, 6) END AS popularity_prior FROM catalogue
UNION ALL
SELECT 'counts', business_id, ROUND(popularity_prior, 6) FROM (WITH {_prior_sql("by_counts", "review_count % 5", "review_count % 7").strip()} SELECT * FROM by_counts)
UNION ALL
SELECT 'scan', business_id, ROUND(popularity_prior, 6) FROM biz_prior""", "catalogue", "biz_prior"))
def prior_source(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    tips, checkins = catalog.tips(spark, sf_dir), catalog.checkins(spark, sf_dir)
    n = F.col("review_count")
    none = F.lit(None).cast("double")
    stored = c.catalogue.withColumn("popularity_prior", F.when(n % 2 == 0, n / 100.0))
    counted = c.catalogue.withColumns({"popularity_prior": none, "tip_count": (n % 5).cast("double"), "checkin_count": (n % 7).cast("double")})
    out = None
    for biz in (stored, counted, c.catalogue):
        rows = prepare.with_prior(biz, tips, checkins).select("prior_source", "business_id", round6("popularity_prior").alias("popularity_prior"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("model_artifact", "S17", with_views("""
SELECT 'summary' AS kind, 'n_businesses' AS name, CAST(COUNT(*) AS DOUBLE) AS value FROM catalogue
UNION ALL SELECT 'summary', 'n_users_with_history', COUNT(DISTINCT user_id) FROM interactions
UNION ALL SELECT 'part', 'catalogue', COUNT(*) FROM catalogue
UNION ALL SELECT 'part', 'history', COUNT(*) FROM interactions
UNION ALL SELECT 'part', 'user_bias', COUNT(*) FROM ubias
UNION ALL SELECT 'part', 'item_bias', COUNT(*) FROM ibias
UNION ALL SELECT 'part', 'user_factors', COUNT(*) FROM ufac
UNION ALL SELECT 'part', 'item_factors', COUNT(*) FROM ifac
UNION ALL SELECT 'part', 'seen', COUNT(*) FROM ratings
UNION ALL SELECT 'part', 'priors', COUNT(*) FROM biz_prior
UNION ALL SELECT 'part', 'vocabulary', COUNT(*) FROM cat_vocab
UNION ALL SELECT 'part', 'item_tfidf', COUNT(*) FROM cat_tfidf
UNION ALL SELECT 'part', 'scalars', 1""", "catalogue", "interactions", "ubias", "ibias", "ufac", "ifac", "ratings", "biz_prior", "cat_vocab", "cat_tfidf"))
def model_artifact(spark, sf_dir):
    """Save, load (which checks every part against the manifest), and the manifest itself."""
    c = Ctx(spark, sf_dir)
    path = _folder(spark, "model")
    hybrid.save_inputs(given_inputs(c), path)
    hybrid.load_inputs(spark, path)
    return files.model_summary(spark, path).select("kind", "name", "value")


FIRST_USERS, EVENTS = 300, 200


@query("chosen_user_events", "J15, W6, W11, W12", with_views(f"""
SELECT user_id, CAST(event_rank AS BIGINT) AS event_rank, business_id, ROUND(stars, 6) AS stars, date FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY date DESC NULLS LAST, business_id) AS event_rank FROM interactions
  WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM interactions ORDER BY user_id LIMIT {FIRST_USERS})
                    UNION SELECT user_id FROM local_log WHERE business_id IN (SELECT business_id FROM catalogue)))
WHERE event_rank <= {EVENTS}""", "interactions", "local_log", "catalogue"))
def chosen_user_events(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    path = _folder(spark, "events")
    activity.write_events_by_user(c.interactions, path)
    chosen = activity.demo_subset(c.interactions, prepare.local_log_rows(c.local_log, c.catalogue), FIRST_USERS)
    events = profiles.user_events(activity.events_of_users(spark.read.parquet(path), chosen), EVENTS)
    ready = activity.demo_ready_users(events, c.interactions)
    return events.join(ready, "user_id", "left_semi").select("user_id", F.col("event_rank").cast("bigint").alias("event_rank"), "business_id",
                                                             round6("stars").alias("stars"), "date")


MAX_USERS = 100


@query("eval_users_capped", "W8, E5", with_views(f"""
SELECT user_id, business_id FROM relevant WHERE user_id IN (SELECT DISTINCT user_id FROM relevant ORDER BY user_id LIMIT {MAX_USERS})""", "relevant"))
def eval_users_capped(spark, sf_dir):
    return evaluate.cap_users(split_parts(Ctx(spark, sf_dir))[3], MAX_USERS).select("user_id", "business_id")


_COUNTERS = [x for x in K.ACCOUNT_COLUMNS if x.startswith("compliment_")]


@query("account_profile", "S12, J16, P18, A16", with_views(f"""
SELECT h.user_id, h.interaction_count, h.review_count, a.name, a.yelping_since, a.review_count AS review_count_profile, ROUND(a.average_stars, 6) AS average_stars,
       ROUND(a.average_stars, 6) AS average_stars_profile, a.useful, a.funny, a.cool, a.useful AS useful_votes, a.funny AS funny_votes, a.cool AS cool_votes,
       a.fans, a.elite, a.elite_year_count, a.friends_count, {", ".join("a." + x for x in _COUNTERS)},
       (COALESCE(a.elite_year_count, 0) > 0 OR trim(COALESCE(a.elite, '')) <> '') AS is_elite_user,
       CASE WHEN COALESCE(a.elite_year_count, 0) > 0 OR trim(COALESCE(a.elite, '')) <> '' THEN 'elite' ELSE 'regular' END AS user_tier
FROM (SELECT user_id, COUNT(*) AS interaction_count, COUNT(*) AS review_count, 'me' AS name FROM interactions GROUP BY user_id) h
LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name, strftime(o.since, '%Y-%m-%d') AS yelping_since, o.n AS review_count, c_acctbal AS average_stars,
         o.useful, o.funny, o.cool, CAST(c_nationkey AS BIGINT) AS fans, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE ' ' END AS elite,
         c_custkey % 4 AS elite_year_count, c_custkey % 50 AS friends_count, {", ".join(f"(c_custkey * {i + 2}) % 7 AS {x}" for i, x in enumerate(_COUNTERS))}
  FROM customer LEFT JOIN (
    SELECT o_custkey, MIN(o_orderdate) AS since, COUNT(*) AS n, COUNT(*) FILTER (o_orderstatus = 'O') AS useful,
           COUNT(*) FILTER (o_orderstatus = 'F') AS funny, COUNT(*) FILTER (o_orderstatus = 'P') AS cool FROM orders GROUP BY 1) o ON o_custkey = c_custkey) a ON a.user_id = h.user_id""", "interactions"))
def account_profile(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    behaviour = c.interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("interaction_count"), F.count(F.lit(1)).alias("review_count"),
                                                      F.lit("me").alias("name"))
    rows = profiles.account_rows(catalog.accounts(spark, sf_dir), behaviour)
    out = profiles.compose_whole_profile(behaviour, rows)
    return out.withColumns({x: round6(x) for x in ("average_stars", "average_stars_profile")})
