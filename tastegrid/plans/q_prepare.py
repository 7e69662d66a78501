"""Preparation queries (S2-S18, P1-P12, J1-J7, A1-A7, U1) and the flagship H8 query."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tastegrid import constants as K
from tastegrid.functions.exprs import attributes_text, round6, wide_attributes_text
from tastegrid.operators import hybrid, prepare
from tastegrid.plans.context import Ctx
from tastegrid.plans.registry import query
from tastegrid.plans.sql_views import with_views
from tastegrid.session import ensure_checkpoint_dir
from tastegrid.sources import catalog, files
from tastegrid.sources.tables import read_table

KEYWORD = "brand#1"   # P2 demo keyword: a case-insensitive regex (matches Brand#1, Brand#10..19)


@query("popularity_fallback_top10", "H8, W5-style top-k, A1-A6, J4-J6, J8", with_views("""
SELECT user_id, business_id, score, rank FROM (
  SELECT u.user_id, s.business_id, ROUND(s.score, 6) AS score,
         ROW_NUMBER() OVER (PARTITION BY u.user_id ORDER BY ROUND(s.score, 6) DESC, s.business_id) AS rank
  FROM (SELECT DISTINCT user_id FROM interactions) u
  CROSS JOIN (SELECT business_id, 0.7 * COALESCE(popularity_prior, 0.0) + 0.3 * COALESCE(stars, 0.0) / 5.0 AS score
              FROM biz_prior) s
  WHERE NOT EXISTS (SELECT 1 FROM interactions i WHERE i.user_id = u.user_id AND i.business_id = s.business_id)
) WHERE rank <= 10""", "interactions", "biz_prior"))
def popularity_fallback_top10(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    out = hybrid.popularity_fallback(c.interactions.select("user_id"), c.biz_prior, c.interactions, 10)
    return out.select("user_id", "business_id", round6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("business_filtered", "S7, P1, P2, P5, P9, P10", with_views(f"""
SELECT business_id, name, categories, attributes, soup, ROUND(stars, 6) AS stars, review_count
FROM business WHERE review_count >= {K.MIN_BUSINESS_REVIEWS}
  AND regexp_matches(COALESCE(categories, ''), '{KEYWORD}', 'i')""", "business"))
def business_filtered(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    out = prepare.load_businesses(c.business, K.MIN_BUSINESS_REVIEWS, KEYWORD)
    return out.select("business_id", "name", "categories", "attributes", "soup", round6("stars").alias("stars"),
                      "review_count")


@query("review_semi_business", "S4-S6, J4, P11, P12", with_views(f"""
SELECT r.user_id, r.business_id, r.stars, r.date FROM review r
WHERE r.business_id IN (SELECT business_id FROM business WHERE review_count >= {K.MIN_BUSINESS_REVIEWS}
                        AND regexp_matches(COALESCE(categories, ''), '{KEYWORD}', 'i'))
  AND r.user_id IS NOT NULL AND r.business_id IS NOT NULL AND r.stars IS NOT NULL""", "review", "business"))
def review_semi_business(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    biz = prepare.filter_businesses(c.business, K.MIN_BUSINESS_REVIEWS, KEYWORD)
    return prepare.select_reviews(c.review, biz)


@query("attribute_text", "P7", """
SELECT CAST(p_partkey AS VARCHAR) AS business_id,
       'size ' || CAST(p_size AS VARCHAR) || ' type ' || p_type AS attributes_map_text,
       'brand ' || trim(p_brand) || ' size ' || CAST(p_size AS VARCHAR) || ' type ' || trim(p_type) AS attributes_wide_text
FROM part""")
def attribute_text(spark, sf_dir):
    base = catalog.business_base(spark, sf_dir).select("business_id", attributes_text("attributes").alias("attributes_map_text"))
    wide = catalog.wide_attributes(spark, sf_dir)
    wt = wide.select("business_id", wide_attributes_text(["brand", "size", "type"]).alias("attributes_wide_text"))
    return base.join(wt, "business_id")


@query("soup_backfill", "S2, J1-J3, P8", with_views("""
SELECT b.business_id,
       CASE WHEN trim(COALESCE(d.text, '')) = ''
            THEN lower(b.name || ' ' || b.categories || ' ' || a.attributes)
            ELSE d.text END AS soup,
       ROUND(pr.popularity_prior, 6) AS popularity_prior
FROM catalogue b
LEFT JOIN (SELECT CAST(p_partkey AS VARCHAR) AS business_id,
                  'brand ' || trim(p_brand) || ' size ' || CAST(p_size AS VARCHAR) || ' type ' || trim(p_type) AS attributes
           FROM part) a ON a.business_id = b.business_id
LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS business_id, text FROM documents) d ON d.business_id = b.business_id
LEFT JOIN biz_prior pr ON pr.business_id = b.business_id""", "catalogue", "biz_prior"))
def soup_backfill(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    out = prepare.attach_side_tables(c.catalogue, catalog.wide_attributes(spark, sf_dir),
                                     catalog.soup_side_table(spark, sf_dir), c.priors)
    return out.select("business_id", "soup", round6("popularity_prior").alias("popularity_prior"))


@query("interactions_built", "S18, A1, A2, J5", with_views("""
SELECT user_id, business_id, ROUND(stars, 6) AS stars, date FROM interactions""", "interactions"))
def interactions_built(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return c.interactions.select("user_id", "business_id", round6("stars").alias("stars"), "date")


@query("tip_checkin_counts", "S8, S9, A3, A4, J6", with_views("""
SELECT c.business_id, COALESCE(t.tip_count, 0.0) AS tip_count, COALESCE(k.checkin_count, 0.0) AS checkin_count
FROM catalogue c LEFT JOIN tip_count t ON t.business_id = c.business_id
LEFT JOIN checkin_count k ON k.business_id = c.business_id""", "catalogue", "tip_count", "checkin_count"))
def tip_checkin_counts(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return c.biz_prior.select("business_id", "tip_count", "checkin_count")


@query("popularity_prior", "A5, A6, J6", with_views("""
SELECT business_id, ROUND(popularity_prior, 6) AS popularity_prior FROM biz_prior""", "biz_prior"))
def popularity_prior(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return c.priors.select("business_id", round6("popularity_prior").alias("popularity_prior"))


@query("dataset_merged", "U1, J7, P12, P17", with_views("""
SELECT user_id, business_id, ROUND(stars, 6) AS stars, date, 'base' AS source FROM interactions
UNION ALL
SELECT user_id, business_id, ROUND(stars, 6) AS stars, date, source FROM local_log
WHERE business_id IN (SELECT business_id FROM catalogue)""", "interactions", "local_log", "catalogue"))
def dataset_merged(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    local = prepare.local_log_rows(c.local_log, c.catalogue)
    out = prepare.merge_datasets(c.interactions, local, "merged")
    return out.select("user_id", "business_id", round6("stars").alias("stars"), "date", "source")


@query("run_summary", "S16", with_views("""
SELECT (SELECT COUNT(*) FROM catalogue) AS n_businesses,
       (SELECT COUNT(*) FROM review_sel) AS n_reviews,
       (SELECT COUNT(*) FROM interactions) AS n_interactions,
       (SELECT COUNT(DISTINCT user_id) FROM interactions) AS n_users,
       (SELECT COUNT(DISTINCT business_id) FROM interactions) AS n_items,
       (SELECT COUNT(*) FROM tip_count) AS n_with_tips,
       (SELECT COUNT(*) FROM checkin_count) AS n_with_checkins""",
    "catalogue", "review_sel", "interactions", "tip_count", "checkin_count"))
def run_summary(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    parts = [
        c.catalogue.agg(F.count(F.lit(1)).alias("n_businesses")),
        c.review_sel.agg(F.count(F.lit(1)).alias("n_reviews")),
        c.interactions.agg(F.count(F.lit(1)).alias("n_interactions"),
                           F.countDistinct("user_id").alias("n_users"),
                           F.countDistinct("business_id").alias("n_items")),
        c.tip_count.agg(F.count(F.lit(1)).alias("n_with_tips")),
        c.checkin_count.agg(F.count(F.lit(1)).alias("n_with_checkins")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)   # single-row aggregates only
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/summary-{uuid.uuid4().hex}"
    files.run_summary({"min_user_reviews": K.MIN_USER_REVIEWS, "min_item_reviews": K.MIN_ITEM_REVIEWS}, out, path)
    return spark.read.schema(out.schema).json(path)


@query("region_filter", "P3, F3", """
SELECT CAST(s.s_suppkey AS VARCHAR) AS business_id, s.s_name AS name, n.n_name AS state
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
WHERE upper(n.n_name) IN (SELECT upper(n2.n_name) FROM nation n2 JOIN region r ON n2.n_regionkey = r.r_regionkey
                          WHERE r.r_name = 'AMERICA')
  AND lower(n.n_name) <> lower('NATION_21')""")
def region_filter(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    biz = (s.join(n, s.s_nationkey == n.n_nationkey)
           .select(F.col("s_suppkey").cast("string").alias("business_id"), F.col("s_name").alias("name"),
                   F.col("n_name").alias("state"), F.lit(10).alias("review_count"), F.lit("").alias("categories")))
    allowed = (n.join(r.filter(F.col("r_name") == "AMERICA"), n.n_regionkey == r.r_regionkey)
               .select(F.col("n_name").alias("state")))
    out = prepare.filter_businesses(biz, 0, None, usa_only=True, allowed_states=allowed)
    out = out.filter(F.lower("state") != "nation_21".lower())
    return out.select("business_id", "name", "state")
