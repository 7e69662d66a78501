import math

import pytest
from pyspark.sql import functions as F

from tastegrid.operators import cf, content, hybrid


@pytest.fixture(scope="module")
def inputs(spark, businesses, interactions):
    item, vocab = content.tfidf(businesses, min_df=1, max_features=500, ngram_max=1)
    model = cf.fit(spark, interactions, n_components=4)
    priors = spark.createDataFrame([(f"b{i:02d}", i / 10.0) for i in range(1, 11)], "business_id string, popularity_prior double")
    return hybrid.HybridInputs(model, item.cache(), vocab.cache(), priors, interactions, businesses)


def test_history_weights(spark, interactions):
    w = {(r.user_id, r.business_id): r for r in hybrid.history_weights(interactions).collect()}
    newest = w[("u1", "b07")]
    assert newest.steps == 0 and newest.weight == pytest.approx(1.0 * (2.0 - 1.0) / 4.0)
    oldest = w[("u1", "b01")]
    assert oldest.steps == 3 and oldest.weight == pytest.approx(math.exp(-3 / 6.0) * 1.0)


def test_history_all_ones_uses_recency(spark):
    import datetime as dt
    h = spark.createDataFrame([("u", "a", 1.0, dt.datetime(2024, 1, 1)), ("u", "b", 1.0, dt.datetime(2024, 1, 2))],
                              "user_id string, business_id string, stars double, date timestamp_ntz")
    got = sorted((r.steps, r.weight) for r in hybrid.history_weights(h).collect())
    assert got[0] == (0, pytest.approx(1.0)) and got[1][1] == pytest.approx(math.exp(-1 / 6.0))


def test_recommend_k_excludes_history_sorted(spark, inputs, interactions):
    out = hybrid.recommend(inputs, interactions.select("user_id").distinct(), 3).collect()
    seen = {(r.user_id, r.business_id) for r in interactions.collect()}
    assert all((r.user_id, r.business_id) not in seen for r in out)
    by = {}
    for r in out:
        by.setdefault(r.user_id, []).append(r)
    assert set(by) == {"u1", "u2", "u3", "u4"} and all(len(v) == 3 for v in by.values())
    for v in by.values():
        v.sort(key=lambda x: x["rank"])
        assert [x.score for x in v] == sorted([x.score for x in v], reverse=True)
        assert all(0.0 <= x.score <= 1.0 for x in v)


def test_blocked_equals_pair_scores(spark, inputs, interactions):
    top = hybrid.recommend(inputs, interactions.select("user_id").distinct(), 5)
    pair = {(r.user_id, r.business_id): r.hybrid_score
            for r in hybrid.score_pairs(inputs, top.select("user_id", "business_id")).collect()}
    for r in top.collect():
        assert r.score == pytest.approx(pair[(r.user_id, r.business_id)], abs=1e-6)


def test_candidates_equal_catalogue_minus_history_when_small(spark, inputs, interactions):
    cand = hybrid.recommend(inputs, interactions.select("user_id").distinct(), 10, emit="candidates")
    counts = {r.user_id: r["count"] for r in cand.groupBy("user_id").count().collect()}
    # limits floor at 50 > catalogue, so every non-history business is a candidate
    assert counts == {"u1": 6, "u2": 6, "u3": 6, "u4": 8}


def test_prior_clip_and_missing(spark, inputs):
    p = {r.business_id: r.prior for r in inputs.priors.collect()}
    assert p["b10"] == 1.0 and p.get("zz") is None


def _raw_priors(spark):
    return spark.createDataFrame([(f"b{i:02d}", i / 10.0) for i in range(1, 11)], "business_id string, popularity_prior double")


def test_empty_history_gets_fallback_in_dispatch(spark, inputs, businesses):
    biz = businesses.join(_raw_priors(spark), "business_id").withColumn("stars", F.lit(4.0))
    users = spark.createDataFrame([("u1",), ("newbie",)], "user_id string")
    out = hybrid.dispatch(inputs, users, biz, 3, ("content",)).collect()
    newbie = sorted((r["rank"], r.business_id) for r in out if r.user_id == "newbie")
    assert [b for _, b in newbie] == ["b10", "b09", "b08"]


def test_explanations(spark, inputs, interactions, businesses):
    biz = businesses.join(_raw_priors(spark), "business_id").withColumn("stars", F.lit(4.0)) \
        .withColumn("review_count", F.lit(10)).withColumn("city", F.lit(None).cast("string")) \
        .withColumn("state", F.lit(None).cast("string")).withColumn("address", F.lit(None).cast("string")) \
        .withColumn("latitude", F.lit(None).cast("double")).withColumn("longitude", F.lit(None).cast("double"))
    recs = hybrid.recommend(inputs, interactions.select("user_id").distinct(), 2)
    rows = hybrid.explain(inputs, recs, biz, "hybrid").collect()
    assert len(rows) == 8
    assert all("Hybrid blend uses alpha=" in r.explanation for r in rows)
    assert all(r.activity_level == "low" for r in rows)


def test_a_ranking_is_computed_once(spark, businesses, interactions, monkeypatch):
    """Fallback and explanations read ranked rows several times: the grid must stand in the plans once, or not at all."""
    item, vocab = content.tfidf(businesses, min_df=1, max_features=500, ngram_max=1)
    priors = businesses.select("business_id", F.lit(0.5).alias("popularity_prior"))
    inp = hybrid.HybridInputs(cf.fit_given(interactions, None, None), item, vocab, priors, interactions, businesses)
    index = (businesses.join(priors, "business_id").withColumns({c: F.lit(None).cast("string") for c in ("city", "state", "address")})
             .withColumns({c: F.lit(1.0) for c in ("latitude", "longitude", "stars")}).withColumn("review_count", F.lit(3)))
    users = interactions.select("user_id").distinct().unionByName(spark.createDataFrame([("new",)], "user_id string"))
    grids = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("CoGroup")
    ranked = hybrid.recommend(inp, users, 3)
    assert grids(ranked) == 1
    assert grids(hybrid.explain(inp, ranked, index)) == 1
    assert grids(hybrid.with_fallback(ranked, users, index, interactions, 3)) == 0


def test_pairs_move_only_the_histories_of_their_users(spark, businesses, interactions, monkeypatch):
    from types import SimpleNamespace

    item, _ = content.tfidf(businesses, min_df=1)
    model = cf.fit_given(interactions, None, None)
    priors = businesses.select("business_id", F.lit(0.5).alias("prior"))
    weighed = []
    monkeypatch.setattr(hybrid, "history_weights", lambda h, f=hybrid.history_weights: weighed.append(h) or f(h))
    inp = SimpleNamespace(history=interactions, item_tfidf=item, model=model, priors=priors, prior_weight=0.1)
    of = lambda users: {(r["user_id"], r["business_id"]): (round(r["content_score"], 9), round(r["hybrid_score"], 9)) for r in hybrid.score_pairs(
        inp, spark.createDataFrame([(u, b) for u in users for b in ("b01", "b06", "none")], "user_id string, business_id string")).collect()}
    one, every = of(["u1"]), of(["u1", "u2", "u3", "u4", "nobody"])
    assert all(every[k] == v for k, v in one.items()) and len(every) == 15
    assert [h.select("user_id").distinct().count() for h in weighed] == [1, 4]
