"""Preparation: business filters, text profile, interactions, auxiliary signals.

Covers P1-P11, A1-A7, J1-J7, U1.  All functions are lazy DataFrame
transformations; nothing is collected.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid import constants as K
from tastegrid.functions.exprs import clamp_rating, parse_ts, soup_expr, wide_attributes_text

# FIXED VALUES: the columns of the business table, in its order.
BUSINESS_KEEP = ("business_id", "name", "city", "state", "address", "latitude", "longitude", "stars",
                 "review_count", "is_open", "categories", "attributes", "soup", "tip_count",
                 "checkin_count", "popularity_prior")


def filter_businesses(biz: DataFrame, min_reviews: int = K.MIN_BUSINESS_REVIEWS,
                      category_keyword: str | None = "Restaurants", usa_only: bool = False,
                      allowed_states: DataFrame | None = None, city: str | None = None,
                      state: str | None = None) -> DataFrame:
    """P1-P4.  Null review counts fail P1; the keyword is a case-insensitive regex.

    ``allowed_states`` (one column ``state``) replaces the fixed US list for P3
    when given; it is joined as a left semi join.
    """
    out = biz.filter(F.col("review_count") >= min_reviews)
    if category_keyword:
        out = out.filter(F.coalesce(F.col("categories"), F.lit("")).rlike("(?i)" + category_keyword))
    if usa_only:
        if allowed_states is not None:
            out = out.join(F.broadcast(allowed_states.select(F.upper("state").alias("_st")).distinct()),
                           F.upper(out["state"]) == F.col("_st"), "left_semi")
        else:
            out = out.filter(F.upper(F.col("state").cast("string")).isin(*K.US_STATE_CODES))
    if city is not None:
        out = out.filter(F.lower(F.col("city")) == city.lower())
    if state is not None:
        out = out.filter(F.lower(F.col("state")) == state.lower())
    return out


def keep_business_columns(biz: DataFrame) -> DataFrame:
    """The fixed keep-list, restricted to the columns present."""
    return biz.select(*[c for c in BUSINESS_KEEP if c in biz.columns])


def dedup_by_business(biz: DataFrame, order_cols: list | None = None) -> DataFrame:
    """P10: one row per business_id, the first by an explicit order (default: name, then review_count desc)."""
    order = order_cols or [F.col("name").asc_nulls_last(), F.col("review_count").desc_nulls_last()]
    w = Window.partitionBy("business_id").orderBy(*order)
    return biz.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def load_businesses(biz: DataFrame, min_reviews: int = K.MIN_BUSINESS_REVIEWS,
                    category_keyword: str | None = "Restaurants", **filters) -> DataFrame:
    """Filters, keep-list and dedup in one lazy plan."""
    return dedup_by_business(keep_business_columns(filter_businesses(biz, min_reviews, category_keyword, **filters)))


def attach_side_tables(biz: DataFrame, wide_attrs: DataFrame | None = None, soup: DataFrame | None = None,
                       popularity: DataFrame | None = None) -> DataFrame:
    """S2 + J1-J3 + P8: left joins of the optional side tables, then soup back-fill.

    A missing attribute or soup table means an empty column.  Where the soup is
    blank after trimming it is rebuilt from name, categories and attributes.
    """
    out = biz.drop("attributes", "soup")
    if wide_attrs is not None:
        cols = [c for c in wide_attrs.columns if c != "business_id"]
        attr = wide_attrs.select("business_id", wide_attributes_text(cols).alias("attributes"))
        out = out.join(attr, "business_id", "left")
    else:
        out = out.withColumn("attributes", F.lit(""))
    if soup is not None:
        out = out.join(soup.select("business_id", "soup"), "business_id", "left")
    else:
        out = out.withColumn("soup", F.lit(""))
    if popularity is not None:
        out = out.join(popularity.select("business_id", "popularity_prior"), "business_id", "left")
    out = (out.withColumn("categories", F.coalesce("categories", F.lit("")))
              .withColumn("name", F.coalesce("name", F.lit("")))
              .withColumn("attributes", F.coalesce("attributes", F.lit("")))
              .withColumn("soup", F.coalesce("soup", F.lit(""))))
    rebuilt = soup_expr(F.col("name"), F.col("categories"), F.col("attributes"))
    return out.withColumn("soup", F.when(F.trim("soup") == "", rebuilt).otherwise(F.col("soup")))


def select_reviews(review: DataFrame, businesses: DataFrame, include_text: bool = False,
                   max_rows: int | None = None, cap_before_filter: bool = False) -> DataFrame:
    """S4-S6, J4, P11, P12.

    Reviews of the selected businesses (left semi join; Spark broadcasts the id
    side when it is small and shuffles otherwise).  ``max_rows`` reproduces the
    two row caps: JSON caps rows *read* (before the filter), Parquet caps rows
    *kept* (after it); the order of user, business and date says which.
    """
    cols = ["user_id", "business_id", "stars", "date"] + (["text"] if include_text and "text" in review.columns else [])
    src = review.select(*cols)
    if max_rows is not None and cap_before_filter:
        src = src.orderBy("user_id", "business_id", "date").limit(max_rows)
    out = src.join(businesses.select("business_id"), "business_id", "left_semi").select(*cols)
    if max_rows is not None and not cap_before_filter:
        out = out.orderBy("user_id", "business_id", "date").limit(max_rows)
    if dict(out.dtypes)["date"] == "string":
        out = out.withColumn("date", parse_ts("date"))
    return out.dropna(subset=["user_id", "business_id", "stars"])


def build_interactions(review: DataFrame, min_user_reviews: int = K.MIN_USER_REVIEWS,
                       min_item_reviews: int = K.MIN_ITEM_REVIEWS) -> DataFrame:
    """A1 + A2 + J5: one row per (user, business) with mean stars and latest date.

    Both thresholds are counted once on the aggregated pairs, before either
    filter (not an iterated k-core).  Counts are aggregated (partial + final)
    and joined back, so a hot user or item is split by the skew-join handling
    instead of landing in one window partition.  The pairs are kept, as both counts
    and the result read them.  Items go first: after a join by item the pairs are clustered
    for it, and what the last join leaves is clustered by user, as most readers ask for.
    """
    pairs = (review.groupBy("user_id", "business_id")
             .agg(F.avg("stars").alias("stars"), F.max("date").alias("date"))).persist(StorageLevel.MEMORY_AND_DISK)
    users = (pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("_nu"))
             .filter(F.col("_nu") >= min_user_reviews).select("user_id"))
    items = (pairs.groupBy("business_id").agg(F.count(F.lit(1)).alias("_ni"))
             .filter(F.col("_ni") >= min_item_reviews).select("business_id"))
    return (pairs.join(items, "business_id", "left_semi")
                 .join(users, "user_id", "left_semi")
                 .select("user_id", "business_id", "stars", "date"))


def tip_counts(tips: DataFrame, businesses: DataFrame) -> DataFrame:
    """A3 + S8: tip rows per selected business."""
    return (tips.join(businesses.select("business_id"), "business_id", "left_semi")
            .groupBy("business_id").agg(F.count(F.lit(1)).cast("double").alias("tip_count")))


def checkin_counts(checkins: DataFrame, businesses: DataFrame) -> DataFrame:
    """A4 + S9: sum of comma-separated tokens per business; an empty string counts 0."""
    d = F.coalesce(F.col("date"), F.lit(""))
    n = F.when(d == "", F.lit(0)).otherwise(F.size(F.split(d, ",")))
    return (checkins.join(businesses.select("business_id"), "business_id", "left_semi")
            .groupBy("business_id").agg(F.sum(n).cast("double").alias("checkin_count")))


def add_business_priors(biz: DataFrame, tip_count: DataFrame | None = None,
                        checkin_count: DataFrame | None = None) -> DataFrame:
    """J6 + A5 + A6: joined counts win, else existing column, else 0; then the prior.

    Min and max of each input come from one global aggregate, whose single row
    is sent to all businesses.
    """
    out = biz
    for name, side in (("tip_count", tip_count), ("checkin_count", checkin_count)):
        existing = F.col(name).cast("double") if name in out.columns else F.lit(None).cast("double")
        if side is not None:
            side = side.select("business_id", F.col(name).alias("_joined"))
            out = out.withColumn("_existing", existing).drop(name).join(side, "business_id", "left")
            out = (out.withColumn(name, F.coalesce("_joined", "_existing", F.lit(0.0)))
                   .drop("_joined", "_existing"))
        else:
            out = out.withColumn(name, F.coalesce(existing, F.lit(0.0)))
    feats = {
        "_n_rev": F.log1p(F.coalesce(F.col("review_count").cast("double"), F.lit(0.0))),
        "_n_star": F.coalesce(F.col("stars").cast("double"), F.lit(0.0)),
        "_n_tip": F.log1p(F.col("tip_count")),
        "_n_chk": F.log1p(F.col("checkin_count")),
    }
    out = out.withColumns(feats)
    # one global aggregate, one row, joined to every business
    stats = out.agg(*[F.min(c).alias("lo" + c) for c in feats], *[F.max(c).alias("hi" + c) for c in feats])
    out = out.crossJoin(F.broadcast(stats))
    normed = []
    for c in feats:
        lo, hi = F.col("lo" + c), F.col("hi" + c)
        normed.append(F.when(lo.isNull() | hi.isNull() | (hi <= lo), F.lit(0.0))
                      .otherwise((F.col(c) - lo) / (hi - lo)))
    prior = (F.lit(K.PRIOR_W_REVIEWS) * normed[0] + F.lit(K.PRIOR_W_STARS) * normed[1]
             + F.lit(K.PRIOR_W_TIPS) * normed[2] + F.lit(K.PRIOR_W_CHECKINS) * normed[3])
    return out.withColumn("popularity_prior", prior.cast("double")).drop(*feats, *stats.columns)


def choose_prior_source(biz: DataFrame) -> str:
    """A7: 'stored' if any stored prior is non-null, else 'counts' if counts are stored, else 'scan'."""
    if "popularity_prior" in biz.columns:
        if biz.select(F.count("popularity_prior")).first()[0] > 0:
            return "stored"
    if "tip_count" in biz.columns or "checkin_count" in biz.columns:
        return "counts"
    return "scan"


def with_prior(biz: DataFrame, tips: DataFrame | None = None, checkins: DataFrame | None = None) -> DataFrame:
    """``biz`` with popularity_prior and prior_source, the source chosen inside the plan.

    A stored prior counts if any business has one ("stored", nulls stay); else the prior is computed from stored counts of tips
    and check-ins where both columns exist ("counts"), else from ``tips`` and ``checkins`` rows ("scan").  Whether one is stored is a
    one-row subquery, known before the other rows are read: where it holds, the filters on it leave nothing of tips and check-ins.
    """
    by_counts = {"tip_count", "checkin_count"} <= set(biz.columns)
    names = [c for c in biz.columns if c != "popularity_prior"]
    stored = F.col("popularity_prior").cast("double") if "popularity_prior" in biz.columns else F.lit(None).cast("double")
    has_stored = biz.select(stored.alias("p")).agg((F.count("p") > 0).alias("any")).scalar()
    kept = biz.withColumn("_stored", stored).drop("popularity_prior")
    if by_counts:
        computed = add_business_priors(kept)
    else:
        sides = [side if side is None else count(side.where(~has_stored), biz) for side, count in ((tips, tip_counts), (checkins, checkin_counts))]
        computed = add_business_priors(kept, *sides)
    return computed.select(*names, F.when(has_stored, F.col("_stored")).otherwise(F.col("popularity_prior")).alias("popularity_prior"),
                           F.when(has_stored, "stored").otherwise("counts" if by_counts else "scan").alias("prior_source"))


def local_log_rows(log: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """P12 + P17 + J7: validated local interactions restricted to the catalogue."""
    out = log.select(F.col("user_id").cast("string"), F.col("business_id").cast("string"),
                     clamp_rating("stars").alias("stars"),
                     (parse_ts("date") if dict(log.dtypes).get("date") == "string" else F.col("date")).alias("date"),
                     F.coalesce(F.col("source"), F.lit("local")).alias("source") if "source" in log.columns
                     else F.lit("local").alias("source"))
    if catalogue is not None:
        out = out.join(catalogue.select("business_id"), "business_id", "left_semi")
    return out.select("user_id", "business_id", "stars", "date", "source")


def merge_datasets(base: DataFrame, local: DataFrame, mode: str = "merged") -> DataFrame:
    """Base only, local only, or both concatenated (duplicates kept)."""
    source = F.col("source") if "source" in base.columns else F.lit("base")
    base = base.select("user_id", "business_id", "stars", "date", source.alias("source"))
    if mode == "base_only":
        return base
    if mode == "local_only":
        return local
    if mode != "merged":
        raise ValueError(f"unknown dataset mode {mode!r}")
    return base.unionByName(local, allowMissingColumns=True)
