import math

import pytest
from pyspark.sql import functions as F

from tastegrid.operators import content
from tastegrid.operators.blocked import ScoreSpec, grid_top_k


@pytest.fixture(scope="module")
def model(businesses):
    item, vocab = content.tfidf(businesses, "business_id", "soup", min_df=1, max_features=500, ngram_max=1)
    return item.cache(), vocab.cache()


def _sim(spark, item, a, b):
    pairs = spark.createDataFrame([(a, b)], "business_a string, business_b string")
    return content.pair_similarity(item, pairs).first().similarity


def test_rows_are_unit_length(model):
    item, _ = model
    norms = item.groupBy("business_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert len(norms) == 10 and all(abs(r.n - 1.0) < 1e-9 for r in norms)


def test_idf_formula(spark):
    docs = spark.createDataFrame([("1", "apple banana"), ("2", "apple cherry"), ("3", "apple")], "business_id string, soup string")
    _, vocab = content.tfidf(docs, min_df=1, ngram_max=1)
    idf = {r.term: r.idf for r in vocab.collect()}
    assert idf["apple"] == pytest.approx(1.0)                      # in every document: ln(4/4) + 1
    assert idf["banana"] == pytest.approx(math.log(4 / 2) + 1.0)


def test_stop_words_removed_before_bigrams(spark):
    docs = spark.createDataFrame([("1", "the pizza and the pasta")], "business_id string, soup string")
    terms = [r.term for r in content.term_counts(docs).collect()]
    assert sorted(terms) == ["pasta", "pizza", "pizza pasta"]


def test_min_df_retry(spark):
    docs = spark.createDataFrame([("1", "alpha"), ("2", "beta")], "business_id string, soup string")
    vocab = content.vocabulary(content.term_counts(docs, ngram_max=1), min_df=2)
    assert sorted(r.term for r in vocab.collect()) == ["alpha", "beta"]


def test_self_similarity_and_unknown(spark, model):
    item, _ = model
    assert _sim(spark, item, "b01", "b01") == pytest.approx(1.0)
    assert _sim(spark, item, "b01", "nope") == 0.0


def test_similar_cuisine_is_closer(spark, model):
    item, _ = model
    assert _sim(spark, item, "b01", "b05") > _sim(spark, item, "b01", "b02")


def test_content_top_k_excludes_history(spark, model, interactions):
    item, vocab = model
    prof = content.user_profiles(interactions, item, "stars")
    vidx = content.vocab_index(vocab)
    users = content.sparse_profile_arrays(prof, vidx)
    items = content.sparse_item_arrays(item, vidx)
    out = grid_top_k(users, items, 3, ScoreSpec("content"), seen=interactions.select("user_id", "business_id")).collect()
    hist = {(r.user_id, r.business_id) for r in interactions.collect()}
    assert all((r.user_id, r.business_id) not in hist for r in out)
    per_user = {}
    for r in out:
        per_user.setdefault(r.user_id, []).append(r)
    assert all(len(v) == 3 for v in per_user.values())
    for v in per_user.values():
        s = [x.score for x in sorted(v, key=lambda x: x["rank"])]
        assert s == sorted(s, reverse=True)


def test_grid_matches_pair_scoring(spark, model, interactions):
    item, vocab = model
    prof = content.user_profiles(interactions, item, None)
    vidx = content.vocab_index(vocab)
    grid = grid_top_k(content.sparse_profile_arrays(prof, vidx), content.sparse_item_arrays(item, vidx), 10,
                      ScoreSpec("content")).collect()
    pairs = spark.createDataFrame([(r.user_id, r.business_id) for r in grid], "user_id string, business_id string")
    direct = {(r.user_id, r.business_id): r.content_score for r in content.score_pairs(prof, item, pairs).collect()}
    for r in grid:
        assert r.score == pytest.approx(direct[(r.user_id, r.business_id)], abs=1e-6)


def test_profiles_fall_back_and_keep_null_weights_out(spark, model):
    item, _ = model
    rows = [("w", "b01", 3.0), ("w", "b05", 1.0), ("w", "b05", None), ("w", "gone", 9.0), ("z", "b01", 0.0), ("z", "b02", 0.0), ("n", "b03", None),
            ("none", "gone", 5.0), (None, "b01", 5.0), ("w", None, 5.0)]
    got = {}
    for r in content.user_profiles(spark.createDataFrame(rows, "user_id string, business_id string, stars double"), item, "stars").collect():
        got.setdefault(r.user_id, {})[r.term] = r.weight
    vec = {}
    for r in item.collect():
        vec.setdefault(r.business_id, {})[r.term] = r.weight

    def mean(*weighted):
        terms = {t for b, _ in weighted for t in vec[b]}
        return pytest.approx({t: sum(w * vec[b].get(t, 0.0) for b, w in weighted) / sum(w for _, w in weighted) for t in terms})

    assert set(got) == {"w", "z", "n"}
    assert got["w"] == mean(("b01", 3.0), ("b05", 1.0)) and got["z"] == mean(("b01", 1.0), ("b02", 1.0)) and got["n"] == mean(("b03", 1.0))


def test_pairs_keep_their_rows_and_meet_each_vector_packed(spark, model):
    item, _ = model
    rows = [("u", "b01", "b05"), ("u", "b01", "b05"), ("v", "b05", "b01"), ("v", None, "b01"), ("x", "b01", "gone")]
    pairs = spark.createDataFrame(rows, "user_id string, business_a string, business_b string")
    out = content.pair_similarity(item, pairs)
    got = {}
    for r in out.collect():
        got.setdefault((r.user_id, r.business_a, r.business_b), []).append(r.similarity)
    same = sum(a.weight * b.weight for a in item.where("business_id = 'b01'").collect() for b in item.where("business_id = 'b05'").collect() if a.term == b.term)
    assert got[rows[0]] == pytest.approx([same, same]) and got[rows[2]] == pytest.approx([same]) and got[rows[3]] == got[rows[4]] == [0.0]
    # no row for each term of a pair, and no sort of rows that carry vectors
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("strategy=shuffle_hash") == 2


def test_texts_are_dealt_out_by_their_length(spark, monkeypatch):
    monkeypatch.setattr(content, "TEXT_CHARS", 10)
    docs = spark.createDataFrame([(str(i), "alpha beta alpha") for i in range(40)] + [("none", None)], "business_id string, soup string")
    counts = content.term_counts(docs)
    assert counts.rdd.getNumPartitions() == 64
    assert sorted({(r.term, r.tf) for r in counts.collect()}) == [("alpha", 2), ("alpha beta", 1), ("beta", 1), ("beta alpha", 1)]
