"""Hybrid blend: popularity fallback, alpha, history weights, candidates, blend, dispatch,
explanations and the paged full-catalogue ranking (H1-H12, U2, U4, U5, J8-J10, J14, W5, W7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid import constants as K
from tastegrid.functions.exprs import alpha_expr, clip01, fixed, normalize_cf, split_categories
from tastegrid.operators import cf as cfm
from tastegrid.operators import content as ct
from tastegrid.operators import profiles as pf
from tastegrid.operators.blocked import ScoreSpec, generate_top_k, grid_top_k
from tastegrid.operators.positions import with_positions_by_key
from tastegrid.operators.ranking import top_k_of_global_order
from tastegrid.session import cut_lineage
from tastegrid.sources.files import load_model, save_model


def fallback_scores(biz_index: DataFrame) -> DataFrame:
    """H8 score: 0.7 * prior + 0.3 * stars / 5, missing values as 0."""
    return biz_index.select(
        "business_id",
        (F.lit(K.FALLBACK_W_PRIOR) * F.coalesce(F.col("popularity_prior"), F.lit(0.0))
         + F.lit(K.FALLBACK_W_STARS) * F.coalesce(F.col("stars"), F.lit(0.0)) / 5.0).alias("score"))


def popularity_fallback(users: DataFrame, biz_index: DataFrame, history: DataFrame | None, k: int = 10) -> DataFrame:
    """H8: per user the k most popular businesses outside the user's history."""
    return top_k_of_global_order(users, fallback_scores(biz_index), history, k)


# ---------------------------------------------------------------------------
# H1-H7
# ---------------------------------------------------------------------------




def history_order(history: DataFrame) -> DataFrame:
    """Adds ``pos`` (1 = oldest) and ``n_hist``: date ascending (nulls last), then business_id."""
    out = with_positions_by_key(history, ["user_id"], [F.col("date").asc_nulls_last(), F.col("business_id")], "pos", "n_hist")
    return out.withColumn("pos", F.col("pos").cast("int"))


def alpha_by_user(history: DataFrame) -> DataFrame:
    """H1 per user from the history length."""
    n = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_history"))
    return n.withColumn("alpha", alpha_expr("n_history"))


def history_weights(history: DataFrame, e_fold: float = K.RECENCY_E_FOLD,
                    lo: float = K.MIN_RATING, hi: float = K.MAX_RATING) -> DataFrame:
    """H2 + W2: exp(-steps / 6) * max(0, (r - lo) / (hi - lo)); recency alone when the sum is <= 0.

    ``steps`` counts positions from the newest entry (0 = newest).
    """
    h = history_order(history)
    steps = F.col("n_hist") - F.col("pos")
    recency = F.exp(-steps.cast("double") / F.lit(max(1.0, e_fold)))
    rng = max(hi - lo, 1e-6)
    pref = F.greatest(F.lit(0.0), (F.col("stars").cast("double") - F.lit(lo)) / F.lit(rng))
    w = F.when(F.col("stars").isNull(), recency).otherwise(recency * pref)
    out = h.withColumn("steps", steps).withColumn("_w", w).withColumn("_rec", recency)
    # summed before the shuffle; the join can split a user with very many rows, a window over the user cannot
    # and needs no exchange where rows are clustered by user (a null-safe join would: rows without a user have their sum apart)
    total = out.groupBy("user_id").agg(F.sum("_w").alias("_total"))
    nobody = out.where("user_id IS NULL").select(F.sum("_w")).scalar()
    out = out.join(total.where("user_id IS NOT NULL"), "user_id", "left").select(*out.columns, "_total")
    of_user = F.when(F.col("user_id").isNull(), nobody).otherwise(F.col("_total"))
    return out.withColumn("weight", F.when(of_user > 0, F.col("_w")).otherwise(F.col("_rec"))).drop("_w", "_rec", "_total")


def prior_scores(priors: DataFrame) -> DataFrame:
    """H4: clip(prior, 0, 1), missing -> 0 (NULL prior deliberately 0, not NaN)."""
    return priors.select("business_id", clip01(F.coalesce(F.col("popularity_prior"), F.lit(0.0))).alias("prior"))


class HybridInputs:
    """Everything the blend needs, as tables: CF model, item TF-IDF + vocabulary, priors, histories."""

    def __init__(self, model: cfm.CFModel, item_tfidf: DataFrame, vocab: DataFrame, priors: DataFrame,
                 history: DataFrame, catalogue: DataFrame, prior_weight: float = K.PRIOR_WEIGHT):
        self.model = model
        self.item_tfidf = item_tfidf
        self.vocab_idx = cut_lineage(ct.vocab_index(vocab))
        self.priors = cut_lineage(prior_scores(priors))
        self.history = history.select("user_id", "business_id", "stars", "date")
        # Where the catalogue is empty, the items of the CF model take its place
        ids = catalogue.select("business_id")
        self.catalogue = cut_lineage(ids.union(model.item_bias.select("business_id").where(~ids.exists())))
        self.prior_weight = float(min(max(prior_weight, 0.0), 0.5))
        self._memo: dict[str, DataFrame] = {}

    def _keep(self, key: str, build) -> DataFrame:
        """Build once per job and write: these tables feed several branches, whose plans then start from the rows."""
        if key not in self._memo:
            self._memo[key] = cut_lineage(build())
        return self._memo[key]

    def weighted_history(self) -> DataFrame:
        return self._keep("weighted_history", lambda: history_weights(self.history))

    def profiles(self) -> DataFrame:
        """H2-weighted content profiles (what the hybrid uses)."""
        return self._keep("profiles", lambda: ct.user_profiles(self.weighted_history(), self.item_tfidf, "weight"))

    def _all_user_side(self) -> DataFrame:
        def build():
            users = self.history.select("user_id").distinct().unionByName(
                self.model.user_bias.select("user_id")).distinct()
            u = cfm.user_side(self.model, users)
            # from the rows as they are summed, by user: written, they would be shuffled once more
            prof = ct.sparse_profile_arrays(ct.user_profiles(self.weighted_history(), self.item_tfidf, "weight"), self.vocab_idx)
            al = alpha_by_user(self.history)
            return u.join(prof, "user_id", "left").join(al.select("user_id", "alpha"), "user_id", "left")
        return self._keep("user_side", build)

    def user_side(self, users: DataFrame) -> DataFrame:
        """Scorer rows for ``users``; users without history or CF rows get alpha(0) and no profile."""
        wanted = users.select("user_id").distinct()
        rows = wanted.join(self._all_user_side(), "user_id", "left")
        return rows.withColumn("alpha", F.coalesce(F.col("alpha"), alpha_expr(F.lit(0))))

    def item_side(self) -> DataFrame:
        def build():
            items = cfm.item_side(self.model, self.catalogue, keep_unknown=True)
            arrays = ct.sparse_item_arrays(self.item_tfidf, self.vocab_idx)
            return items.join(arrays, "business_id", "left").join(self.priors, "business_id", "left")
        return self._keep("item_side", build)

    def spec(self, **kw) -> ScoreSpec:
        return ScoreSpec(kw.pop("mode", "hybrid_gen"), mu=self.model.mu, lo=self.model.lo, hi=self.model.hi,
                         prior_weight=self.prior_weight, **kw)


def save_inputs(inp: HybridInputs, path: str) -> None:
    """The fitted model and all that scoring needs, one Parquet table each."""
    m = inp.model
    tables = {"user_bias": m.user_bias, "item_bias": m.item_bias, "user_factors": m.user_factors,
              "item_factors": m.item_factors, "seen": m.seen, "item_tfidf": inp.item_tfidf, "vocabulary": inp.vocab_idx,
              "priors": inp.priors, "history": inp.history, "catalogue": inp.catalogue}
    spark = inp.history.sparkSession
    tables["scalars"] = spark.createDataFrame([(m.mu, m.lo, m.hi, inp.prior_weight)],
                                              "mu double, lo double, hi double, prior_weight double")
    save_model(tables, path, {"n_businesses": inp.catalogue.count(), "n_users_with_history": inp.history.select("user_id").distinct().count()})


def load_inputs(spark, path: str) -> HybridInputs:
    """The scorer of ``save_inputs``, read from its files."""
    parts = load_model(spark, path)
    table = parts.get
    one = table("scalars").first()
    model = cfm.CFModel(one["mu"], table("user_bias"), table("item_bias"), table("user_factors"), table("item_factors"),
                        table("seen"), one["lo"], one["hi"])
    out = HybridInputs.__new__(HybridInputs)
    out.model, out.item_tfidf, out.vocab_idx = model, table("item_tfidf"), table("vocabulary")
    out.priors, out.history, out.catalogue = table("priors"), table("history"), table("catalogue")
    out.prior_weight, out._memo = one["prior_weight"], {}
    return out


def recommend(inp: HybridInputs, users: DataFrame, k: int = 10, emit: str = "topk",
              cf_limit: int = K.CF_CANDIDATES, content_limit: int = K.CONTENT_CANDIDATES,
              prior_limit: int = K.PRIOR_CANDIDATES, exclude_history: bool = True) -> DataFrame:
    """H5 + H6 + H7 for every user: candidates, blend, top-k (or the candidate set with scores).

    The CF gate ranks all items of the model that the user has not rated, the content gate the catalogue
    outside the history, the prior gate is the head of the prior order; what is in the catalogue and outside
    the history is blended.  Users whose gates leave nothing get the whole catalogue (U2).
    """
    floor = K.CANDIDATE_FLOOR
    spec = inp.spec(emit=emit, cf_limit=max(floor, cf_limit), content_limit=max(floor, content_limit),
                    exclude_history=exclude_history)
    head = (inp.priors.orderBy(F.round("prior", 6).desc(), "business_id").limit(max(floor, prior_limit))
            .select("business_id", F.lit(True).alias("prior_top")))
    cat = inp.item_side().withColumn("in_cat", F.lit(True))
    other = cfm.item_side(inp.model, inp.model.item_bias.select("business_id").join(inp.catalogue, "business_id", "left_anti"),
                          keep_unknown=True).withColumn("in_cat", F.lit(False))
    items = (cat.unionByName(other, allowMissingColumns=True).join(head, "business_id", "left")
             .withColumn("prior_top", F.coalesce("prior_top", F.lit(False))))
    history = inp.history.select("user_id", "business_id").distinct()
    return generate_top_k(inp.user_side(users), items, k, spec, history, inp.model.seen.select("user_id", "business_id"))


def recommend_among(inp: HybridInputs, candidates: DataFrame, k: int = 10) -> DataFrame:
    """H7 with explicit candidates: H6 scores of each user's own candidate list, top k.

    Runs in the blocked scorer on the listed pairs alone (no per-pair joins).
    """
    users = candidates.select("user_id").distinct()
    return grid_top_k(inp.user_side(users), inp.item_side(), k, inp.spec(mode="hybrid"),
                      allowed=candidates.select("user_id", "business_id"))


def score_pairs(inp: HybridInputs, pairs: DataFrame, history_count: DataFrame | None = None) -> DataFrame:
    """H6 for explicit (user_id, business_id) pairs; adds content_score, cf_pred, prior, alpha, hybrid_score.

    ``history_count`` (user_id, n_history) overrides the history length used for alpha.
    """
    p = pairs.select("user_id", "business_id").distinct()
    # a user's weights and profile come from their own history: that of other users need not be moved
    mine = inp.history.join(p.select("user_id").distinct(), "user_id", "left_semi")
    withc = ct.score_pairs(cut_lineage(ct.user_profiles(history_weights(mine), inp.item_tfidf, "weight"), "profiles"), inp.item_tfidf, p)
    withc = cfm.predict_pairs(inp.model, withc)
    counts = history_count if history_count is not None else alpha_by_user(inp.history).select("user_id", "n_history")
    out = (withc.join(inp.priors, "business_id", "left").join(counts, "user_id", "left")
           .withColumn("prior", F.coalesce("prior", F.lit(0.0)))
           .withColumn("alpha", alpha_expr(F.coalesce(F.col("n_history"), F.lit(0)))))
    core = F.col("alpha") * F.col("content_score") + (F.lit(1.0) - F.col("alpha")) * normalize_cf(F.col("cf_pred"), inp.model.lo, inp.model.hi)
    return out.withColumn("hybrid_score", F.lit(1.0 - inp.prior_weight) * core + F.lit(inp.prior_weight) * F.col("prior"))


# ---------------------------------------------------------------------------
# H9, H10, H12, U4, U5, J14
# ---------------------------------------------------------------------------



def content_recommend(inp: HybridInputs, users: DataFrame, k: int, weight_col: str | None) -> DataFrame:
    """M7 for every user: profile from raw ratings (``weight_col="stars"``) or the plain mean (None)."""
    hist = inp.history
    prof = ct.user_profiles(hist, inp.item_tfidf, weight_col)
    uside = users.select("user_id").distinct().join(ct.sparse_profile_arrays(prof, inp.vocab_idx), "user_id")
    items = inp.catalogue.join(ct.sparse_item_arrays(inp.item_tfidf, inp.vocab_idx), "business_id", "left")
    return grid_top_k(uside, items, k, ScoreSpec("content"), seen=hist.select("user_id", "business_id"))


def with_fallback(ranked: DataFrame, users: DataFrame, biz_index: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """U4 + J14: users without any ranked row get the popularity fallback (history excluded)."""
    # written: the ranking is read for its rows, for its users and by the fallback's own steps, and is a grid each time
    ranked = cut_lineage(ranked.select("user_id", "business_id", "score", "rank"), "ranked")
    missing = users.select("user_id").distinct().join(ranked.select("user_id").distinct(), "user_id", "left_anti")
    fb = popularity_fallback(missing, biz_index, history.select("user_id", "business_id"), k)
    return ranked.unionByName(fb.select("user_id", "business_id", "score", "rank"))


def dispatch(inp: HybridInputs, users: DataFrame, biz_index: DataFrame, k: int = 10,
             algorithms: tuple[str, ...] = ("content", "cf", "hybrid")) -> DataFrame:
    """H9: per algorithm, its ranking; the popularity fallback fills users left empty.

    content: raw ratings weigh the profile; the fallback only applies to an
    empty history (an unresolvable history stays empty).  cf: C5 (unknown users
    rank by item bias).  hybrid: H7.
    """
    out = []
    for algo in algorithms:
        if algo == "content":
            r = content_recommend(inp, users, k, "stars")
            no_hist = users.select("user_id").distinct().join(inp.history.select("user_id").distinct(), "user_id", "left_anti")
            fb = popularity_fallback(no_hist, biz_index, None, k)
            r = r.select("user_id", "business_id", "score", "rank").unionByName(fb.select("user_id", "business_id", "score", "rank"))
        elif algo in ("cf", "collaborative"):
            r = with_fallback(cfm.recommend_top_k(inp.model, users, k), users, biz_index, inp.history, k)
        else:
            r = with_fallback(recommend(inp, users, k), users, biz_index, inp.history, k)
        out.append(r.withColumn("algorithm", F.lit(algo)))
    res = out[0]
    for r in out[1:]:
        res = res.unionByName(r)
    return res


def explain(inp: HybridInputs, recs: DataFrame, biz_index: DataFrame, algorithm: str = "hybrid") -> DataFrame:
    """Enrich (user_id, business_id, score, rank) with business info, components and reason tags."""
    hist = pf.user_history(inp.history)
    counts = hist.groupBy("user_id").agg(F.count(F.lit(1)).alias("history_count"))
    top = pf.top_category_arrays(pf.user_top_categories(hist, biz_index))
    if "content_score" in recs.columns and "cf_pred" in recs.columns:
        # the blocked scorer already emitted the blend's components for these rows: a join with themselves would rank once more
        out = recs
    else:
        parts = score_pairs(inp, recs.select("user_id", "business_id"))
        out = recs.join(parts.select("user_id", "business_id", "content_score", "cf_pred"), ["user_id", "business_id"], "left")
    info = biz_index.select("business_id", "name", "city", "state", "address", "latitude", "longitude", "stars",
                            "review_count", "categories", "popularity_prior")
    out = (out.join(info, "business_id", "left")
           .join(counts, "user_id", "left").join(top, "user_id", "left")
           .withColumn("history_count", F.coalesce("history_count", F.lit(0)).cast("bigint"))
           .withColumn("hybrid_alpha", alpha_expr(F.col("history_count")))
           .withColumn("activity_level", pf.activity_level("history_count"))
           .withColumn("prior_score", F.coalesce(F.col("popularity_prior"), F.lit(0.0)))
           .withColumn("content_score", F.when(F.col("history_count") > 0, F.coalesce("content_score", F.lit(0.0)))
                       .otherwise(F.lit(0.0)))
           .withColumn("category_overlap", F.array_sort(F.array_intersect(
               F.array_distinct(split_categories("categories")),
               F.coalesce(F.col("top_categories"), F.array().cast("array<string>"))))))
    tags = F.array_compact(F.array(
        F.when(F.size("category_overlap") > 0,
               F.format_string(K.TEXT_CATEGORY, F.array_join(F.slice("category_overlap", 1, 3), ", "))),
        F.when(F.col("content_score") >= K.CONTENT_REASON_THRESHOLD,
               F.format_string(K.TEXT_CONTENT.replace("%.3f", "%s"), fixed(F.col("content_score"), 3))),
        F.when(F.col("cf_pred") >= K.CF_REASON_THRESHOLD,
               F.format_string(K.TEXT_CF.replace("%.2f", "%s"), fixed(F.col("cf_pred"), 2))),
        F.when(F.lit(algorithm == "hybrid"), F.format_string(K.TEXT_ALPHA.replace("%.3f", "%s"),
                                                             fixed(F.col("hybrid_alpha"), 3), F.col("activity_level")))))
    tags = F.when(F.col("history_count") == 0, F.array(F.lit(K.TEXT_COLD_START))).otherwise(tags)
    tags = F.when(F.size(tags) == 0, F.array(F.lit(K.TEXT_DEFAULT))).otherwise(tags)
    return (out.withColumn("reason_tags", tags)
            .withColumn("explanation", F.array_join("reason_tags", " "))
            .withColumn("category_overlap", F.slice("category_overlap", 1, 5))
            .withColumn("algorithm", F.lit(algorithm))
            .withColumnRenamed("cf_pred", "cf_pred_rating"))


def full_ranking_page(inp: HybridInputs, users: DataFrame, biz_index: DataFrame, algorithm: str,
                      offset: int = 0, limit: int = 20) -> DataFrame:
    """H12 + W7: one page of the whole-catalogue ranking, with total, has_more and next_offset.

    Only the first offset + limit positions are ever produced per user (top-k
    in the blocked scorer), the total is counted, not materialised.
    """
    limit = max(1, min(40, int(limit)))
    offset = max(0, int(offset))
    depth = offset + limit
    seen = inp.history.select("user_id", "business_id")
    n_cat = inp.catalogue.count()
    in_cat_hist = seen.join(inp.catalogue, "business_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("_h"))
    base_users = users.select("user_id").distinct()
    if algorithm == "content":
        ranked = content_recommend(inp, users, depth, None)
        total = base_users.join(in_cat_hist, "user_id", "left").select(
            "user_id", (F.lit(n_cat) - F.coalesce("_h", F.lit(0))).alias("total"))
    elif algorithm in ("cf", "collaborative"):
        cf_rank = cfm.recommend_top_k(inp.model, users, depth)
        n_cf = inp.model.item_bias.count()
        cf_seen = seen.join(inp.model.item_bias.select("business_id"), "business_id", "left_semi") \
                      .groupBy("user_id").agg(F.count(F.lit(1)).alias("_s"))
        t0 = base_users.join(cf_seen, "user_id", "left").select("user_id", (F.lit(n_cf) - F.coalesce("_s", F.lit(0))).alias("_t0"))
        tier1_items = inp.catalogue.join(inp.model.item_bias.select("business_id"), "business_id", "left_anti")
        tier1 = popularity_fallback(base_users, biz_index.join(tier1_items, "business_id", "left_semi"), seen, depth)
        tier1 = tier1.join(t0, "user_id").withColumn("rank", F.col("rank") + F.col("_t0")).drop("_t0")
        ranked = cf_rank.select("user_id", "business_id", "score", "rank").unionByName(tier1.select("user_id", "business_id", "score", "rank"))
        n_t1 = tier1_items.count()
        total = t0.select("user_id", (F.col("_t0") + F.lit(n_t1)).alias("total"))
    else:
        ranked = grid_top_k(inp.user_side(users), inp.item_side(), depth, inp.spec(mode="hybrid"), seen=seen, n_items=n_cat)
        total = base_users.join(in_cat_hist, "user_id", "left").select(
            "user_id", (F.lit(n_cat) - F.coalesce("_h", F.lit(0))).alias("total"))
    page = ranked.filter((F.col("rank") > offset) & (F.col("rank") <= depth))
    has_more = F.lit(depth) < F.col("total")
    return (page.join(total, "user_id")
            .select("user_id", F.lit(algorithm).alias("algorithm"), F.col("rank").cast("bigint").alias("rank"), "business_id",
                    F.col("total").cast("bigint").alias("total"), has_more.alias("has_more"),
                    F.when(has_more, F.lit(depth)).cast("bigint").alias("next_offset")))
