import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tastegrid.operators import blocked, cf, content, hybrid
from tastegrid.operators.ranking import top_k_of_global_order


def test_global_order_minus_own_items_matches_brute_force(spark):
    rnd = random.Random(3)
    items = [(f"i{j:02d}", float(rnd.randint(0, 9))) for j in range(30)]       # many score ties
    users = [f"u{u}" for u in range(12)]
    excl = [(u, f"i{j:02d}") for u in users for j in rnd.sample(range(30), rnd.randint(0, 25))]
    idf = spark.createDataFrame(items, "business_id string, score double")
    udf = spark.createDataFrame([(u,) for u in users], "user_id string")
    edf = spark.createDataFrame(excl, "user_id string, business_id string")
    got = {}
    for r in top_k_of_global_order(udf, idf, edf, 5).collect():
        got.setdefault(r.user_id, []).append((r["rank"], r.business_id))
    order = [b for b, _ in sorted(items, key=lambda x: (-x[1], x[0]))]
    for u in users:
        mine = {b for uu, b in excl if uu == u}
        want = [b for b in order if b not in mine][:5]
        assert [b for _, b in sorted(got.get(u, []))] == want


def _inputs(spark, businesses, interactions, history=None):
    item, vocab = content.tfidf(businesses, min_df=1, max_features=500, ngram_max=1)
    model = cf.fit(spark, interactions, n_components=4)
    priors = spark.createDataFrame([(f"b{i:02d}", i / 10.0) for i in range(1, 11)], "business_id string, popularity_prior double")
    # b03 is rated, but not in the catalogue
    catalogue = businesses.where("business_id <> 'b03'")
    return hybrid.HybridInputs(model, item, vocab, priors, interactions if history is None else history, catalogue)


def _brute(inp, users, k, limits, exclude_history):
    """H5 to H7 from the scores of all pairs."""
    pairs = users.crossJoin(inp.catalogue.unionByName(inp.model.item_bias.select("business_id")).distinct())
    scored = {(r.user_id, r.business_id): r for r in hybrid.score_pairs(inp, pairs).collect()}
    cf4 = {(r.user_id, r.business_id): r.score for r in cf.recommend_top_k(
        cf.CFModel(inp.model.mu, inp.model.user_bias, inp.model.item_bias, inp.model.user_factors, inp.model.item_factors,
                   inp.model.seen), users, 100).collect()}
    cat = sorted(r.business_id for r in inp.catalogue.collect())
    prior = {r.business_id: r.prior or 0.0 for r in inp.priors.collect()}
    head = sorted(prior, key=lambda b: (-round(prior[b], 6), b))[:limits[2]]
    with_profile = {r.user_id for r in inp.profiles().select("user_id").distinct().collect()}
    out = {}
    for u in sorted(r.user_id for r in users.collect()):
        hist = {r.business_id for r in inp.history.where(f"user_id = '{u}'").collect()} if exclude_history else set()
        by_cf = sorted((b for (w, b) in cf4 if w == u), key=lambda b: (-round(cf4[u, b], 6), b))[:limits[0]]
        by_ct = sorted((b for b in cat if b not in hist), key=lambda b: (-round(scored[u, b].content_score, 6), b))[:limits[1]]
        cand = (set(by_cf) | (set(by_ct) if u in with_profile else set()) | set(head)) & set(cat) - hist
        cand = cand or set(cat) - hist
        top = sorted(cand, key=lambda b: (-round(scored[u, b].hybrid_score, 6), b))[:k]
        out.update({(u, i + 1): (b, round(scored[u, b].hybrid_score, 6)) for i, b in enumerate(top)})
    return out


@pytest.mark.parametrize("exclude_history", [True, False])
@pytest.mark.parametrize("limits", [(2, 2, 1), (1, 3, 2), (5, 1, 3)])
def test_gates_smaller_than_the_catalogue(spark, businesses, interactions, monkeypatch, limits, exclude_history):
    monkeypatch.setattr(hybrid.K, "CANDIDATE_FLOOR", 1)
    # histories differ from what the model has seen: u1 has one entry more, u4 none, u9 is unknown to the model
    history = (interactions.where("user_id <> 'u4'")
               .unionByName(spark.createDataFrame([("u1", "b02", 4.0, None), ("u9", "b05", 5.0, None)], interactions.schema)))
    users = spark.createDataFrame([(u,) for u in ("u1", "u2", "u3", "u4", "u9", "new")], "user_id string")
    inp = _inputs(spark, businesses, interactions, history)
    want = _brute(inp, users, 4, limits, exclude_history)

    def run():
        rows = hybrid.recommend(_inputs(spark, businesses, interactions, history), users, 4, cf_limit=limits[0],
                                content_limit=limits[1], prior_limit=limits[2], exclude_history=exclude_history).collect()
        return {(r.user_id, r["rank"]): (r.business_id, pytest.approx(r.score, abs=2e-6)) for r in rows}

    assert run() == want
    monkeypatch.setattr(blocked, "ITEMS_PER_BLOCK", 3)     # four item blocks
    assert run() == want


def test_gates_may_leave_nothing(spark, businesses, interactions, monkeypatch):
    monkeypatch.setattr(hybrid.K, "CANDIDATE_FLOOR", 0)
    # a history of all the prior gate holds and of what the user's CF and content gates find
    inp = _inputs(spark, businesses, interactions)
    users = spark.createDataFrame([("u1",)], "user_id string")
    first = {r.business_id for r in hybrid.recommend(inp, users, 10, emit="candidates", cf_limit=1, content_limit=0, prior_limit=1).collect()}
    more = spark.createDataFrame([("u1", b, None, None) for b in sorted(first)], interactions.schema)
    full = _inputs(spark, businesses, interactions, interactions.unionByName(more))
    got = hybrid.recommend(full, users, 3, cf_limit=1, content_limit=0, prior_limit=1).collect()
    assert len(got) == 3 and not first & {r.business_id for r in got}


def test_multi_block_content_equals_single_block(spark, businesses, interactions, monkeypatch):
    users = interactions.select("user_id").distinct()

    def run():
        inp = _inputs(spark, businesses, interactions)
        return {(r.user_id, r["rank"]): (r.business_id, r.score)
                for r in hybrid.content_recommend(inp, users, 4, "stars").collect()}

    single = run()
    monkeypatch.setattr(blocked, "ITEMS_PER_BLOCK", 3)     # four item blocks
    multi = run()
    assert single.keys() == multi.keys()
    for key, (b, s) in single.items():
        assert multi[key][0] == b and multi[key][1] == pytest.approx(s, abs=1e-6)


def test_vectors_null_and_empty_are_absent():
    rows = pd.Series([np.array([1.0, 2.0]), None, np.array([]), np.array([3.0, 4.0])], dtype=object)
    out, present = blocked._dense(rows)
    assert out.tolist() == [[1, 2], [0, 0], [0, 0], [3, 4]] and present.tolist() == [True, False, False, True]
    out, present = blocked._dense(pd.Series([None, np.array([])], dtype=object))
    assert out.shape == (2, 0) and not present.any()
    out, _ = blocked._dense(rows, 3)
    assert out[3].tolist() == [3, 4, 0]


def test_cold_users_and_unknown_items_in_the_grid(spark):
    """Null vectors, null biases and pairs travel together; excluded pairs stay out."""
    users = spark.createDataFrame([("u1", [1.0, 0.0], 0.5), ("u2", None, None)], "user_id string, u_vec array<double>, u_bias double")
    items = spark.createDataFrame([("a", [1.0, 0.0], 0.0), ("b", [0.0, 1.0], 0.2), ("c", [0.5, 0.0], 0.1)],
                                  "business_id string, i_vec array<double>, i_bias double")
    seen = spark.createDataFrame([("u1", "a"), ("u2", "b")], "user_id string, business_id string")
    out = blocked.grid_top_k(users, items, 5, blocked.ScoreSpec("cf", mu=2.0), seen=seen)
    got = sorted((r.user_id, r["rank"], r.business_id, round(r.score, 6)) for r in out.collect())
    assert got == [("u1", 1, "c", 3.1), ("u1", 2, "b", 2.7), ("u2", 1, "c", 2.1), ("u2", 2, "a", 2.0)]


def test_factor_blocks_rank_like_all_cells_sorted():
    rng = np.random.default_rng(3)
    items = pd.DataFrame({"business_id": [f"{i:04d}" for i in range(900)], "i_bias": [None if i % 97 == 0 else rng.normal() for i in range(900)],
                          "i_vec": [rng.normal(size=4) if i % 50 else np.array([]) for i in range(900)]})
    # users with very many clipped scores at either end, unknown ones, ones without a vector
    users = pd.DataFrame({"user_id": [f"u{i}" for i in range(60)], "u_bias": [None if i % 31 == 0 else float(i % 3 - 1) * 6 for i in range(60)],
                          "u_vec": [rng.normal(size=4) if i % 20 else np.array([]) for i in range(60)], "_kind": 0})
    seen = pd.DataFrame({"user_id": [f"u{i}" for i in rng.integers(0, 60, 900)], "business_id": [f"{i:04d}" for i in rng.integers(0, 900, 900)], "_kind": 1})
    got = blocked._make_block_fn(blocked.ScoreSpec("cf", mu=3.0), 10)(pd.concat([users, seen], ignore_index=True), items)
    gone = set(zip(seen["user_id"], seen["business_id"], strict=True))
    for u in users.itertuples():
        rows = []
        for i in items.itertuples():
            dot = float(u.u_vec @ i.i_vec) if len(u.u_vec) and len(i.i_vec) else 0.0
            raw = 3.0 + (0.0 if pd.isna(i.i_bias) else i.i_bias) + (0.0 if pd.isna(u.u_bias) else u.u_bias + dot)
            if (u.user_id, i.business_id) not in gone:
                rows.append((-round(min(5.0, max(1.0, raw)), 6), i.business_id))
        mine = got[got["user_id"] == u.user_id]
        assert sorted(zip(-mine["score"], mine["business_id"], strict=True)) == sorted(rows)[:10]


def test_rows_with_factors_alone_go_to_larger_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocked, "ITEMS_PER_BLOCK", 3)
    seen = {}
    monkeypatch.setattr(blocked, "_grid", lambda users, items, pairs, n_ub, n_ib, fn, schema: seen.update(n_ib=n_ib) or users.sparkSession.createDataFrame([], schema))
    items = spark.createDataFrame([(f"b{i}", 0.0, [1.0]) for i in range(12)], "business_id string, i_bias double, i_vec array<double>")
    users = spark.createDataFrame([("u", 0.0, [1.0])], "user_id string, u_bias double, u_vec array<double>")
    blocked.grid_top_k(users, items, 2, blocked.ScoreSpec("cf"))
    assert seen["n_ib"] == 1


def _block(rng, n_items, n_users, n_terms):
    """A block of a content and factor grid: items without terms, bias or factors, users without, ties, excluded pairs."""
    def sparse(p_none, most):
        some = [np.sort(rng.choice(n_terms, rng.integers(1, most), replace=False)) if rng.random() > p_none else np.array([], int)
                for _ in range(max(n_items, n_users))]
        return some, [rng.integers(1, 4, len(t)) / 4 for t in some]

    t_idx, t_val = (x[:n_items] for x in sparse(0.05, 5))
    items = pd.DataFrame({"business_id": [f"{i:05d}" for i in range(n_items)], "t_idx": t_idx, "t_val": t_val,
                          "i_bias": [None if i % 41 == 0 else rng.normal() / 4 for i in range(n_items)],
                          "i_vec": [rng.normal(size=4) / 4 if i % 37 else np.array([]) for i in range(n_items)],
                          "prior": rng.random(n_items), "in_cat": rng.random(n_items) > 0.1, "prior_top": rng.random(n_items) > 0.99})
    p_idx, p_val = (x[:n_users] for x in sparse(0.1, 30))
    users = pd.DataFrame({"user_id": [f"u{i}" for i in range(n_users)], "p_idx": p_idx, "p_val": p_val, "alpha": rng.random(n_users),
                          "u_bias": [None if i % 13 == 0 else float(rng.normal()) * (9 if i % 17 == 0 else 0.3) for i in range(n_users)],
                          "u_vec": [rng.normal(size=4) if i % 11 else np.array([]) for i in range(n_users)], "_kind": 0, "_ib": 0})
    pairs = [pd.DataFrame({"user_id": [f"u{i}" for i in rng.integers(0, n_users, 3_000)],
                           "business_id": [f"{i:05d}" for i in rng.integers(0, n_items, 3_000)], "_kind": kind}).drop_duplicates() for kind in (1, 4)]
    return users, items, pairs


@pytest.mark.parametrize("emit", ["topk", "candidates"])
def test_cells_over_the_floor_rank_like_all_cells(monkeypatch, emit):
    rng = np.random.default_rng(5)
    users, items, pairs = _block(rng, 3_000, 60, 50)
    monkeypatch.setattr(blocked, "TILE", 700)
    spec = blocked.ScoreSpec("hybrid_gen", mu=3.0, cf_limit=40, content_limit=30, emit=emit)
    left = pd.concat([users, *pairs], ignore_index=True)

    def rows(out):
        return sorted((r.user_id, r.business_id, round(r.score, 6), round(r.content_score, 6)) for r in out.itertuples())

    def run():
        content = blocked._make_block_fn(blocked.ScoreSpec("content"), 10)(left, items)
        one = blocked._make_block_fn(blocked.replace(spec, one_block=True), 10)(left, items)
        halves = [items[:1_400], items[1_400:]]
        gates = pd.concat([blocked._make_block_fn(blocked.replace(spec, mode="gates"), 10)(left.assign(_ib=i), half) for i, half in enumerate(halves)])
        bounds = []
        for user, mine in gates.groupby("user_id"):
            parts = {name: blocked._bounds([np.frombuffer(b) for b in mine[name]], limit) for name, limit in (("cf", 40), ("ct", 30))}
            bounds += [{"user_id": user, "_ib": b, "cf_bound": parts["cf"][0], "cf_ties": parts["cf"][1][i], "ct_bound": parts["ct"][0],
                        "ct_ties": parts["ct"][1][i]} for i, b in enumerate(mine["_ib"])]
        bounds = pd.DataFrame(bounds)
        two = []
        for i, half in enumerate(halves):
            given = pd.concat([users.drop(columns="_ib").merge(bounds[bounds["_ib"] == i], on="user_id"), *pairs], ignore_index=True)
            two.append(blocked._make_block_fn(spec, 10)(given, half))
        two = pd.concat(two).query("spare == 0")
        if emit == "topk":
            two = two.sort_values(["score", "business_id"], ascending=[False, True]).groupby("user_id").head(10)
        return rows(content), rows(one), rows(two)

    monkeypatch.setattr(blocked, "FAST_SHARE", 10 ** 9)
    want = run()
    assert want[1] == want[2]
    monkeypatch.setattr(blocked, "FAST_SHARE", 16)
    calls = []
    over = blocked._GroupedTerms.over
    monkeypatch.setattr(blocked._GroupedTerms, "over", lambda *a: calls.append(1) or over(*a))
    assert run() == want and calls
    monkeypatch.setattr(blocked, "DENSE_TERM_CELLS", 20_000)    # groups of dense items that are not kept
    assert run() == want


def test_profiles_go_to_large_blocks(spark, monkeypatch):
    """A user's profile is copied to every block of items: blocks of items alone must be few."""
    seen = {}
    monkeypatch.setattr(blocked, "_grid", lambda users, items, pairs, n_ub, n_ib, fn, schema: seen.update(n_ib=n_ib) or users.sparkSession.createDataFrame([], schema))
    items = spark.createDataFrame([("b", [0], [1.0])], "business_id string, t_idx array<int>, t_val array<double>")
    users = spark.createDataFrame([("u", [0], [1.0])], "user_id string, p_idx array<int>, p_val array<double>")
    blocked.grid_top_k(users, items, 2, blocked.ScoreSpec("content"), n_users=1, n_items=1_200_000)
    assert seen["n_ib"] <= 6


def test_users_stream_by_in_chunks_and_items_are_copied_few_times(spark, monkeypatch):
    users = spark.createDataFrame([(f"u{i:02}", 0.1, [float(i), 1.0]) for i in range(40)], "user_id string, u_bias double, u_vec array<double>")
    items = spark.createDataFrame([(f"b{i:02}", 0.01 * i, [0.01, i / 50]) for i in range(30)], "business_id string, i_bias double, i_vec array<double>")
    seen = spark.createDataFrame([(f"u{i:02}", f"b{j:02}") for i in range(40) for j in range(i % 7)] + [("none", "b01"), (None, "b02")],
                                 "user_id string, business_id string")
    spec = blocked.ScoreSpec("cf", mu=2.0)
    rows = lambda: sorted(tuple(r) for r in blocked.grid_top_k(users, items, 5, spec, seen=seen).select("user_id", "business_id", "score", "rank").collect())
    want = rows()
    assert len(want) == 200
    monkeypatch.setattr(blocked, "CHUNK_USERS", 3)
    monkeypatch.setattr(blocked, "ITEMS_PER_BLOCK", 4)
    assert rows() == want
    sizes = []

    def fn(left, right):
        assert len(right) == 30 and left["user_id"].is_monotonic_increasing
        sizes.append(left["user_id"].nunique())
        return left[["user_id"]].drop_duplicates()
    left = pd.DataFrame({"user_id": [None] * 30 + [f"u{i // 4:02}" for i in range(40)], "_kind": [-1] * 30 + [0, 1, 1, 4] * 10})
    schema = pa.schema([("user_id", pa.string())])
    # batches end within the items and within a user
    batches = pa.RecordBatch.from_pandas(left)
    parts = [batches.slice(a, 7) for a in range(0, 70, 7)]
    got = [x for b in blocked._streamed(fn, ["user_id", "_kind"], schema)(iter(parts)) for x in b.column(0).to_pylist()]
    assert got == [f"u{i:02}" for i in range(10)] and sizes == [3, 3, 3, 1]
    # 900,000 users and 1.2 million items: 45 copies of each item before, 450 where candidates are asked for
    grids = []
    monkeypatch.setattr(blocked, "ITEMS_PER_BLOCK", 20_000)
    monkeypatch.setattr(blocked, "_grid", lambda users, items, pairs, n_ub, n_ib, fn, schema: grids.append((n_ub, n_ib)) or users.sparkSession.createDataFrame([], schema))
    blocked.grid_top_k(users, items, 2, blocked.ScoreSpec("hybrid"), n_users=900_000, n_items=1_200_000)
    assert grids == [(9, 15)]


def test_candidates_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(blocked, "CHUNK_USERS", 1)      # streamed
    items = spark.createDataFrame([(f"b{i}", 0.0, [1.0], [0], [1.0], 0.1, True, True) for i in range(4)],
                                  "business_id string, i_bias double, i_vec array<double>, t_idx array<int>, t_val array<double>, prior double, in_cat boolean, prior_top boolean")
    users = spark.createDataFrame([(u, 0.0, [1.0], [0], [1.0], 0.5) for u in "uv"],
                                  "user_id string, u_bias double, u_vec array<double>, p_idx array<int>, p_val array<double>, alpha double")
    none = spark.createDataFrame([("u", "b0")], "user_id string, business_id string")
    out = blocked.generate_top_k(users, items, 2, blocked.ScoreSpec("hybrid_gen", mu=3.0, emit="candidates"), none, none)
    assert sorted((r["user_id"], r["business_id"]) for r in out.collect()) == [*(("u", f"b{i}") for i in (1, 2, 3)), *(("v", f"b{i}") for i in range(4))]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("MapInArrow") < plan.index("RepartitionBy")
