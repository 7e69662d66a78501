"""Profile, catalogue and search queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tastegrid import constants as K
from tastegrid.functions.exprs import fixed, hour_token_minutes, is_elite, open_now, round6, split_categories
from tastegrid.operators import hybrid, profiles
from tastegrid.plans.context import Ctx, written_reviews
from tastegrid.plans.registry import query
from tastegrid.plans.sql_views import _view, fixed_sql, with_views
from tastegrid.sources import catalog

AS_OF = dt.datetime(2024, 1, 30, 23, 0, 0)
SEARCH_Q = "red"
FILTER_Q, FILTER_CATS = "bolt", "SMALL, Brand#2 ,,"


@query("user_history", "A12", with_views(
    "SELECT user_id, CAST(pos AS BIGINT) AS pos, business_id, ROUND(stars, 6) AS stars, date FROM hist", "hist"))
def user_history(spark, sf_dir):
    h = profiles.user_history(Ctx(spark, sf_dir).interactions)
    return h.select("user_id", F.col("pos").cast("bigint").alias("pos"), "business_id", round6("stars").alias("stars"), "date")


_view("top_cat_text", ("user_cats",), """
SELECT user_id, list(category ORDER BY cat_rank) AS cats FROM user_cats GROUP BY user_id""")


@query("user_profile", "A13, A14, A15", with_views(f"""
SELECT h.user_id, h.interaction_count, ROUND(h.avg_given_stars, 6) AS avg_given_stars,
       ROUND(h.positive_rating_ratio, 6) AS positive_rating_ratio,
       COALESCE(array_to_string(t.cats, ', '), '') AS top_categories, h.recent_activity_date,
       CASE WHEN h.interaction_count < 5 THEN 'low' WHEN h.interaction_count < 25 THEN 'medium' ELSE 'high' END AS activity_level,
       'User has ' || CASE WHEN h.interaction_count < 5 THEN 'low' WHEN h.interaction_count < 25 THEN 'medium' ELSE 'high' END
         || ' activity with ' || CAST(h.interaction_count AS VARCHAR) || ' interactions, average given stars '
         || {fixed_sql('h.avg_given_stars', 2)} || ', and most often engages with '
         || COALESCE(array_to_string(t.cats[1:3], ', '), 'mixed categories') || '.' AS activity_summary
FROM (SELECT user_id, COUNT(*) AS interaction_count, AVG(stars) AS avg_given_stars,
             AVG(CASE WHEN stars >= 4.0 THEN 1.0 ELSE 0.0 END) AS positive_rating_ratio, MAX(date) AS recent_activity_date
      FROM interactions GROUP BY user_id) h
LEFT JOIN top_cat_text t ON t.user_id = h.user_id""", "interactions", "top_cat_text"))
def user_profile(spark, sf_dir):
    c = written_reviews(Ctx(spark, sf_dir))
    hist = profiles.user_history(c.interactions)
    ev = profiles.user_events(c.interactions)
    out = profiles.user_profile(hist, c.catalogue, ev)
    return out.select("user_id", "interaction_count", round6("avg_given_stars").alias("avg_given_stars"),
                      round6("positive_rating_ratio").alias("positive_rating_ratio"),
                      F.array_join("top_categories", ", ").alias("top_categories"), "recent_activity_date",
                      "activity_level", "activity_summary")


@query("user_tier", "A16", with_views("""
SELECT h.user_id, h.interaction_count, a.name, ROUND(a.average_stars, 6) AS average_stars_profile, a.elite,
       strftime(h.first_date, '%Y-%m-%d') AS member_since,
       (COALESCE(a.elite_year_count, 0) > 0 OR trim(COALESCE(a.elite, '')) <> '') AS is_elite_user,
       CASE WHEN (COALESCE(a.elite_year_count, 0) > 0 OR trim(COALESCE(a.elite, '')) <> '') THEN 'elite' ELSE 'regular' END AS user_tier
FROM (SELECT user_id, COUNT(*) AS interaction_count, MIN(date) AS first_date FROM interactions GROUP BY user_id) h
LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name, c_acctbal AS average_stars,
                  c_mktsegment AS elite, CAST(NULL AS BIGINT) AS elite_year_count FROM customer) a ON a.user_id = h.user_id""",
    "interactions"))
def user_tier(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    beh = c.interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("interaction_count"),
                                                F.date_format(F.min("date"), "yyyy-MM-dd").alias("member_since"))
    # Only the requested users' account rows are read (left semi join), friends never loaded
    acct = catalog.account_profiles(spark, sf_dir).join(beh.select("user_id"), "user_id", "left_semi")
    out = profiles.compose_profile(beh, acct)
    return out.select("user_id", "interaction_count", "name", round6("average_stars_profile").alias("average_stars_profile"),
                      "elite", "member_since", "is_elite_user", "user_tier")


@query("user_events", "W6, J11", with_views("""
SELECT e.user_id, CAST(e.event_rank AS BIGINT) AS event_rank, e.date, e.business_id, b.name AS business_name, b.city,
       ROUND(e.stars, 6) AS stars, b.categories
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY date DESC NULLS LAST, business_id) AS event_rank
      FROM interactions) e
LEFT JOIN catalogue b ON b.business_id = e.business_id
WHERE e.event_rank <= 30""", "interactions", "catalogue"))
def user_events(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    ev = profiles.user_events(c.interactions).filter(F.col("event_rank") <= 30)
    info = c.catalogue.select("business_id", F.col("name").alias("business_name"), "city", "categories")
    return (ev.join(info, "business_id", "left")
            .select("user_id", F.col("event_rank").cast("bigint").alias("event_rank"), "date", "business_id",
                    "business_name", "city", round6("stars").alias("stars"), "categories"))


@query("category_counts", "A17, P16", with_views("""
SELECT category, count FROM (
  SELECT trim(c) AS category, COUNT(*) AS count
  FROM (SELECT unnest(string_split(COALESCE(categories, ''), ',')) AS c FROM catalogue)
  WHERE trim(c) <> '' GROUP BY 1)
ORDER BY count DESC, category LIMIT 300""", "catalogue"))
def category_counts(spark, sf_dir):
    return profiles.category_counts(Ctx(spark, sf_dir).catalogue, 300)


@query("search_keyword", "P13", with_views(f"""
SELECT business_id, name, city, categories, ROUND(stars, 6) AS stars, review_count,
       ROUND(popularity_prior, 6) AS popularity_prior
FROM biz_prior
WHERE strpos(lower(COALESCE(name, '') || ' ' || COALESCE(city, '') || ' ' || COALESCE(categories, '')), '{SEARCH_Q}') > 0
ORDER BY business_id LIMIT 20""", "biz_prior"))
def search_keyword(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    out = profiles.search(c.biz_prior, SEARCH_Q, 20, empty_query_returns_nothing=True)
    return out.select("business_id", "name", "city", "categories", round6("stars").alias("stars"), "review_count",
                      round6("popularity_prior").alias("popularity_prior"))


@query("search_filtered", "P14, P15, F7", with_views(f"""
SELECT business_id, name, city, state, ROUND(stars, 6) AS stars, review_count, categories
FROM biz_prior
WHERE strpos(lower(COALESCE(name, '')), '{FILTER_Q}') > 0
  AND len(list_intersect(list_transform(list_filter(list_transform(string_split(COALESCE(categories, ''), ','),
                                                                    lambda x: trim(x)), lambda x: x <> ''),
                                        lambda x: lower(x)),
                         ['small', 'brand#2'])) > 0
ORDER BY business_id LIMIT 20""", "biz_prior"))
def search_filtered(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    wanted = [x.strip() for x in FILTER_CATS.split(",") if x.strip()]   # F7: comma list parameter
    out = profiles.search(c.biz_prior, FILTER_Q, min(20, 100), wanted, name_only=True)
    return out.select("business_id", "name", "city", "state", round6("stars").alias("stars"), "review_count", "categories")


def _hours_long(spark, sf_dir):
    """Wide opening hours -> (business_id, day, hours); blank or missing days dropped."""
    wide = catalog.opening_hours(spark, sf_dir)
    long = wide.unpivot(["business_id"], list(K.WEEKDAYS), "day", "hours")
    return long.filter(F.col("hours").isNotNull() & (F.trim("hours") != ""))


@query("open_now", "F1, F2, S10, J17", with_views(f"""
SELECT t.business_id, t.hours,
       CASE WHEN t.hours IS NULL OR strpos(t.hours, '-') = 0 OR q.o IS NULL OR q.c IS NULL THEN NULL
            WHEN q.c = q.o THEN TRUE
            WHEN q.c > q.o THEN ({AS_OF.hour * 60 + AS_OF.minute} >= q.o AND {AS_OF.hour * 60 + AS_OF.minute} < q.c)
            ELSE ({AS_OF.hour * 60 + AS_OF.minute} >= q.o OR {AS_OF.hour * 60 + AS_OF.minute} < q.c) END::VARCHAR AS open_now
FROM (SELECT c.business_id, h.hours FROM catalogue c
      LEFT JOIN (SELECT CAST(p_partkey AS VARCHAR) AS business_id,
                        CAST(p_size % 24 AS VARCHAR) || ':0-' || CAST((p_size * 7) % 24 AS VARCHAR) || ':0' AS hours
                 FROM part WHERE p_partkey % 7 = {AS_OF.weekday()}) h ON h.business_id = c.business_id) t
LEFT JOIN (SELECT business_id,
                  CASE WHEN oh BETWEEN 0 AND 24 AND om BETWEEN 0 AND 59 AND NOT (oh = 24 AND om <> 0) THEN oh * 60 + om END AS o,
                  CASE WHEN ch BETWEEN 0 AND 24 AND cm BETWEEN 0 AND 59 AND NOT (ch = 24 AND cm <> 0) THEN ch * 60 + cm END AS c
           FROM (SELECT CAST(p_partkey AS VARCHAR) AS business_id, p_size % 24 AS oh, 0 AS om, (p_size * 7) % 24 AS ch, 0 AS cm
                 FROM part WHERE p_partkey % 7 = {AS_OF.weekday()})) q ON q.business_id = t.business_id""", "catalogue"))
def open_now_q(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    day = K.WEEKDAYS[AS_OF.weekday()]
    hours = _hours_long(spark, sf_dir).filter(F.col("day") == day)     # J17: (business, weekday of as_of)
    now_min = F.lit(AS_OF.hour * 60 + AS_OF.minute)
    out = c.catalogue.select("business_id").join(hours.select("business_id", "hours"), "business_id", "left")
    # nullable boolean emitted as text ('true' / 'false' / null) for a representation-stable result
    return out.select("business_id", "hours", open_now(F.col("hours"), now_min).cast("string").alias("open_now"))


@query("geo_fill", "J12, S11", with_views("""
SELECT r.user_id, r.business_id,
       CASE WHEN r.have AND r.latitude IS NOT NULL THEN r.latitude + 1.0 ELSE g.latitude END AS latitude,
       CASE WHEN r.have AND r.latitude IS NOT NULL THEN r.longitude ELSE g.longitude END AS longitude,
       CASE WHEN r.have THEN COALESCE(r.address, CASE WHEN r.latitude IS NULL THEN g.address END) ELSE g.address END AS address
FROM (SELECT t.user_id, t.business_id, CAST(t.business_id AS BIGINT) % 3 = 0 AS have, o.latitude, o.longitude,
             CASE WHEN CAST(t.business_id AS BIGINT) % 2 = 0 THEN o.address END AS address FROM (SELECT user_id, business_id FROM (
        SELECT u.user_id, s.business_id,
               ROW_NUMBER() OVER (PARTITION BY u.user_id ORDER BY ROUND(s.score, 6) DESC, s.business_id) AS rank
        FROM (SELECT DISTINCT user_id FROM interactions) u
        CROSS JOIN (SELECT business_id, 0.7 * COALESCE(popularity_prior, 0.0) + 0.3 * COALESCE(stars, 0.0) / 5.0 AS score
                    FROM biz_prior) s
        WHERE NOT EXISTS (SELECT 1 FROM interactions i WHERE i.user_id = u.user_id AND i.business_id = s.business_id))
      WHERE rank <= 10) t LEFT JOIN business o ON o.business_id = t.business_id) r
LEFT JOIN (SELECT business_id, latitude, longitude, address FROM business
           WHERE latitude IS NOT NULL AND longitude IS NOT NULL) g ON g.business_id = r.business_id""",
    "interactions", "biz_prior", "business"))
def geo_fill(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    recs = hybrid.popularity_fallback(c.interactions.select("user_id"), c.biz_prior, c.interactions, 10)
    # every third business brings its own coordinates (null for some), every sixth an address too
    have = F.col("business_id").cast("long") % 3 == 0
    own = catalog.business_base(spark, sf_dir).select("business_id", "latitude", "longitude", "address")
    recs = recs.select("user_id", "business_id").join(own, "business_id", "left").select(
        "user_id", "business_id", F.when(have, F.col("latitude") + 1.0).alias("latitude"), F.when(have, F.col("longitude")).alias("longitude"),
        F.when(F.col("business_id").cast("long") % 6 == 0, F.col("address")).alias("address"))
    geo = (catalog.business_base(spark, sf_dir).select("business_id", "latitude", "longitude", "address")
           .dropna(subset=["latitude", "longitude"]))                        # S11
    g = geo.select("business_id", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), F.col("address").alias("_adr"))
    out = recs.join(g, "business_id", "left")
    # Fill only when either coordinate is missing; the flag is taken before anything is filled
    out = out.withColumn("_need", F.col("latitude").isNull() | F.col("longitude").isNull())
    need = F.col("_need")
    has = F.col("_lat").isNotNull()
    out = (out.withColumn("latitude", F.when(need & has, F.col("_lat")).otherwise(F.col("latitude")))
              .withColumn("longitude", F.when(need & has, F.col("_lon")).otherwise(F.col("longitude")))
              .withColumn("address", F.when(need & has & F.col("address").isNull(), F.col("_adr")).otherwise(F.col("address"))))
    return out.select("user_id", "business_id", "latitude", "longitude", "address")


@query("user_sample", "W10", with_views("""
SELECT user_id, name, short_id, CASE WHEN is_elite_user THEN 'Elite | ' ELSE '' END || name || ' - ' || short_id AS label,
       is_elite_user, CASE WHEN is_elite_user THEN 'elite' ELSE 'regular' END AS user_tier
FROM (SELECT u.user_id, COALESCE(NULLIF(trim(COALESCE(a.c_name, '')), ''), 'User') AS name, substr(u.user_id, 1, 6) AS short_id,
             trim(COALESCE(a.c_mktsegment, '')) <> '' AS is_elite_user
      FROM (SELECT DISTINCT user_id FROM interactions) u
      LEFT JOIN customer a ON CAST(a.c_custkey AS VARCHAR) = u.user_id
      ORDER BY md5('42|' || u.user_id), u.user_id LIMIT 30)""", "interactions"))
def user_sample(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    users = c.interactions.select("user_id").distinct()                     # W12: users having events/histories
    picked = users.orderBy(F.md5(F.concat(F.lit(f"{K.SEED}|"), F.col("user_id"))), "user_id").limit(30)
    acct = catalog.account_profiles(spark, sf_dir).join(picked, "user_id", "left_semi")
    out = picked.join(acct, "user_id", "left")
    name = F.coalesce(F.when(F.trim(F.coalesce("name", F.lit(""))) != "", F.trim("name")), F.lit("User"))
    elite = is_elite(F.col("elite_year_count"), F.col("elite"))
    short = F.substring("user_id", 1, 6)
    label = F.concat(F.when(elite, F.lit("Elite | ")).otherwise(F.lit("")), name, F.lit(" - "), short)
    return out.select("user_id", name.alias("name"), short.alias("short_id"), label.alias("label"),
                      elite.alias("is_elite_user"), F.when(elite, "elite").otherwise("regular").alias("user_tier"))
