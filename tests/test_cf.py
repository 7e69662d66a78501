import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.operators import cf, svd


@pytest.fixture(scope="module")
def fitted(spark, interactions):
    return cf.fit(spark, interactions, n_components=4)


def test_biases(spark, interactions):
    r = cf.ratings(interactions)
    mu, ub, ib = cf.fit_biases(r)
    stars = [x.stars for x in interactions.collect()]
    assert mu == pytest.approx(np.mean(stars))
    u1 = [x.stars for x in interactions.collect() if x.user_id == "u1"]
    assert ub.filter("user_id = 'u1'").first().bias == pytest.approx(np.mean(u1) - mu)
    assert ub.count() == 4 and ib.count() == 10


def test_factor_shapes(fitted):
    assert fitted.user_factors.count() == 4
    assert fitted.item_factors.count() == 10
    assert len(fitted.item_factors.first().factors) == 3          # min(4, min(4, 10) - 1)


def test_svd_matches_dense(spark, interactions):
    r = cf.ratings(interactions)
    mu, ub, ib = cf.fit_biases(r)
    res = cf.residuals(r, mu, ub, ib)
    uf, itf, s = cf.fit_svd(spark, res, n_components=3, n_iter=20)
    users = sorted({x.user_id for x in res.collect()})
    items = sorted({x.business_id for x in res.collect()})
    R = np.zeros((len(users), len(items)))
    for x in res.collect():
        R[users.index(x.user_id), items.index(x.business_id)] = x.residual
    U, S, Vt = np.linalg.svd(R, full_matrices=False)
    assert np.allclose(s, S[:3], atol=1e-6)
    approx = (U[:, :3] * S[:3]) @ Vt[:3]
    P = np.array([x.factors for x in sorted(uf.collect(), key=lambda x: users.index(x.user_id))])
    Q = np.array([x.factors for x in sorted(itf.collect(), key=lambda x: items.index(x.business_id))])
    assert np.allclose(P @ Q.T, approx, atol=1e-6)                 # sign-independent check
    assert np.allclose(Q.T @ Q, np.eye(3), atol=1e-6)              # orthonormal item factors


def test_predictions_in_range_and_unknowns(spark, fitted):
    pairs = spark.createDataFrame([("u1", "b02"), ("zz", "b02"), ("u1", "zz"), ("zz", "zz")], "user_id string, business_id string")
    got = {(r.user_id, r.business_id): r.cf_pred for r in cf.predict_pairs(fitted, pairs).collect()}
    assert all(1.0 <= v <= 5.0 for v in got.values())
    b02 = fitted.item_bias.filter("business_id = 'b02'").first().bias
    bu1 = fitted.user_bias.filter("user_id = 'u1'").first().bias
    assert got[("zz", "b02")] == pytest.approx(min(5, max(1, fitted.mu + b02)))
    assert got[("u1", "zz")] == pytest.approx(min(5, max(1, fitted.mu + bu1)))
    assert got[("zz", "zz")] == pytest.approx(fitted.mu)


def test_batch_equals_single(spark, fitted):
    top = cf.recommend_top_k(fitted, fitted.user_bias.select("user_id"), 10)
    single = {(r.user_id, r.business_id): r.cf_pred
              for r in cf.predict_pairs(fitted, top.select("user_id", "business_id")).collect()}
    for r in top.collect():
        assert r.score == pytest.approx(single[(r.user_id, r.business_id)], abs=1e-6)


def test_top_k_excludes_seen_and_is_sorted(spark, fitted, interactions):
    top = cf.recommend_top_k(fitted, fitted.user_bias.select("user_id"), 3).collect()
    seen = {(r.user_id, r.business_id) for r in interactions.collect()}
    assert not any((r.user_id, r.business_id) in seen for r in top)
    by_user = {}
    for r in top:
        by_user.setdefault(r.user_id, []).append(r)
    for rows in by_user.values():
        rows.sort(key=lambda x: x["rank"])
        assert [x.score for x in rows] == sorted([x.score for x in rows], reverse=True)


def test_unknown_user_ranks_by_item_bias(spark, fitted):
    users = spark.createDataFrame([("new",)], "user_id string")
    top = cf.recommend_top_k(fitted, users, 3).orderBy("rank").collect()
    best = fitted.item_bias.orderBy(F.col("bias").desc(), "business_id").limit(3).collect()
    assert [r.business_id for r in top] == [b.business_id for b in best]


def _against_dense(spark, dense, rank, **kw):
    """Singular values and product of the distributed SVD of the non-zero cells against NumPy."""
    rows = [(f"u{i}", f"b{j}", float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    df = spark.createDataFrame(rows, "u string, b string, x double").repartition(3)
    u, v, s, residual = svd.truncated_svd(df, "u", "b", "x", rank, **kw)
    U, S, Vt = np.linalg.svd(dense, full_matrices=False)
    P, Q = np.zeros((dense.shape[0], len(s))), np.zeros((dense.shape[1], len(s)))
    for r in u.collect():
        P[int(r["u"][1:])] = r["factors"]
    for r in v.collect():
        Q[int(r["b"][1:])] = r["factors"]
    assert np.allclose(Q.T @ Q, np.eye(len(s)), atol=1e-8)
    return s, S[:rank], P @ Q.T, (U[:, :rank] * S[:rank]) @ Vt[:rank], residual


def test_svd_of_a_flat_spectrum_with_a_hot_user(spark, monkeypatch):
    monkeypatch.setattr(svd, "BLOCK", 32)                # many blocks
    monkeypatch.setattr(svd, "ENTRIES", 17)              # and tiles multiplied in pieces
    monkeypatch.setattr(svd, "SLICE", 5)
    rnd = np.random.default_rng(4)
    dense = rnd.normal(size=(150, 120)) * (rnd.random((150, 120)) < 0.08)
    dense[7] = rnd.normal(size=120)                      # one user with every item
    got, want, product, exact, residual = _against_dense(spark, dense, 8, oversample=4)
    assert np.abs(got / want - 1).max() < 1e-3 and residual <= svd.TOLERANCE
    got, want, product, exact, _ = _against_dense(spark, dense, 8, oversample=4, tolerance=1e-9, max_steps=30)
    assert np.allclose(got, want, rtol=1e-9) and np.allclose(product, exact, atol=1e-5)


def test_svd_of_low_rank_and_wide_gaps(spark):
    rnd = np.random.default_rng(5)
    dense = (rnd.normal(size=(40, 3)) * [1e3, 1.0, 1e-1]) @ rnd.normal(size=(3, 30))
    got, want, product, exact, _ = _against_dense(spark, dense, 6, tolerance=1e-9)
    assert len(got) == 3 and np.allclose(got, want[:3], rtol=1e-6) and np.allclose(product, exact, atol=1e-4)


def test_svd_of_nothing(spark):
    none = spark.createDataFrame([], "u string, b string, x double")
    u, v, s, _ = svd.truncated_svd(none, "u", "b", "x", 3)
    assert u.count() == 0 and v.count() == 0 and len(s) == 0


def test_top_k_over_written_factors_in_sql(spark, fitted, interactions, tmp_path):
    """The fitted model's ranking is what SQL gives over its written tables."""
    import duckdb
    for name in ("user_bias", "item_bias", "user_factors", "item_factors", "seen"):
        getattr(fitted, name).write.parquet(f"{tmp_path}/{name}")
    t = lambda n: f"read_parquet('{tmp_path}/{n}/*.parquet')"
    want = duckdb.sql(f"""
        SELECT user_id, business_id, score FROM (
          SELECT ub.user_id, ib.business_id, round(least(5.0, greatest(1.0, {fitted.mu} + ub.bias + ib.bias
                 + list_inner_product(uf.factors, f.factors))), 6) AS score
          FROM {t("user_bias")} ub JOIN {t("user_factors")} uf USING (user_id)
          CROSS JOIN {t("item_bias")} ib JOIN {t("item_factors")} f USING (business_id)
          WHERE NOT EXISTS (SELECT 1 FROM {t("seen")} s WHERE s.user_id = ub.user_id AND s.business_id = ib.business_id))
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, business_id) <= 3""").fetchall()
    got = cf.recommend_top_k(fitted, fitted.user_bias.select("user_id"), 3).collect()
    assert sorted((r.user_id, r.business_id, round(r.score, 6)) for r in got) == sorted(want)


def test_basis_blocks_are_gathered_once_a_step(spark, monkeypatch):
    """Each pass over the basis reads the kept blocks; it does not move them by block again."""
    plans, total = [], svd._total
    monkeypatch.setattr(svd, "_total", lambda m, shape: plans.append(m._jdf.queryExecution().withCachedData().toString()) or total(m, shape))
    rows = [(f"u{i}", f"b{j}", float((7 * i + 3 * j) % 5)) for i in range(12) for j in range(9)]
    svd.truncated_svd(spark.createDataFrame(rows, "u string, b string, v double"), "u", "b", "v", 3)
    assert len(plans) > 2 and all("InMemoryRelation" in p and "FlatMapGroups" not in p.split("InMemoryRelation")[0] for p in plans)
