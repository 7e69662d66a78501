"""The catalogue mapping and shared preparation steps written as DuckDB SQL.

Used only by ``oracle_sql()`` to check the Spark jobs.  Each entry is a CTE;
``with_views(body, *names)`` prepends the named CTEs and their dependencies.
"""

from __future__ import annotations

from tastegrid import constants as K
from tastegrid.functions.permute import sql_permuted

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in K.STOP_WORDS)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (deps, sql)


_view("review", (), """
SELECT CAST(o.o_custkey AS VARCHAR) AS user_id, CAST(l.l_partkey AS VARCHAR) AS business_id,
       CAST(LEAST(5.0, 1.0 + FLOOR((l.l_quantity - 1) / 10)) AS DOUBLE) AS stars, o.o_orderdate AS date
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")

_view("bstats", ("review",), """
SELECT business_id, COUNT(*) AS review_count, AVG(stars) AS stars FROM review GROUP BY business_id""")

_view("business", ("bstats",), """
SELECT CAST(p.p_partkey AS VARCHAR) AS business_id, p.p_name AS name,
       CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS state,
       CAST(p.p_size AS VARCHAR) || ' Main St' AS address,
       CASE WHEN p.p_partkey % 10 = 0 THEN NULL ELSE 40.0 + p.p_size / 100.0 END AS latitude,
       CASE WHEN p.p_partkey % 10 = 0 THEN NULL ELSE -74.0 - p.p_size / 100.0 END AS longitude,
       1 AS is_open,
       p.p_type || ', ' || p.p_brand AS categories,
       'size ' || CAST(p.p_size AS VARCHAR) || ' type ' || p.p_type AS attributes,
       CAST(COALESCE(s.review_count, 0) AS BIGINT) AS review_count, s.stars AS stars,
       lower(p.p_name || ' ' || p.p_type || ', ' || p.p_brand || ' ' || 'size ' || CAST(p.p_size AS VARCHAR)
             || ' type ' || p.p_type) AS soup
FROM part p LEFT JOIN bstats s ON s.business_id = CAST(p.p_partkey AS VARCHAR)""")

# Model catalogue: businesses with at least MIN_BUSINESS_REVIEWS reviews (no category keyword).
_view("catalogue", ("business",), f"""
SELECT * FROM business WHERE review_count >= {K.MIN_BUSINESS_REVIEWS}""")

_view("review_sel", ("review", "catalogue"), """
SELECT r.user_id, r.business_id, r.stars, r.date FROM review r
WHERE r.business_id IN (SELECT business_id FROM catalogue)
  AND r.user_id IS NOT NULL AND r.business_id IS NOT NULL AND r.stars IS NOT NULL""")

_view("pairs", ("review_sel",), """
SELECT user_id, business_id, AVG(stars) AS stars, MAX(date) AS date FROM review_sel GROUP BY user_id, business_id""")

_view("interactions", ("pairs",), f"""
SELECT p.user_id, p.business_id, p.stars, p.date FROM pairs p
WHERE p.user_id IN (SELECT user_id FROM pairs GROUP BY user_id HAVING COUNT(*) >= {K.MIN_USER_REVIEWS})
  AND p.business_id IN (SELECT business_id FROM pairs GROUP BY business_id HAVING COUNT(*) >= {K.MIN_ITEM_REVIEWS})""")

_view("tips", (), """
SELECT json_extract_string(props, '$.k') AS business_id, ts AS date FROM events WHERE event_type = 'click'""")

_view("checkins", (), """
SELECT business_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S'), ',') AS date
FROM (SELECT json_extract_string(props, '$.k') AS business_id, ts FROM events WHERE event_type = 'view')
GROUP BY business_id, CAST(ts AS DATE)""")

_view("tip_count", ("tips", "catalogue"), """
SELECT business_id, CAST(COUNT(*) AS DOUBLE) AS tip_count FROM tips
WHERE business_id IN (SELECT business_id FROM catalogue) GROUP BY business_id""")

_view("checkin_count", ("checkins", "catalogue"), """
SELECT business_id,
       CAST(SUM(CASE WHEN COALESCE(date, '') = '' THEN 0 ELSE len(string_split(date, ',')) END) AS DOUBLE) AS checkin_count
FROM checkins WHERE business_id IN (SELECT business_id FROM catalogue) GROUP BY business_id""")

_view("prior_feats", ("catalogue", "tip_count", "checkin_count"), """
SELECT c.*, COALESCE(t.tip_count, 0.0) AS tip_count, COALESCE(k.checkin_count, 0.0) AS checkin_count,
       ln(1 + COALESCE(CAST(c.review_count AS DOUBLE), 0.0)) AS f_rev,
       COALESCE(c.stars, 0.0) AS f_star,
       ln(1 + COALESCE(t.tip_count, 0.0)) AS f_tip,
       ln(1 + COALESCE(k.checkin_count, 0.0)) AS f_chk
FROM catalogue c LEFT JOIN tip_count t ON t.business_id = c.business_id
LEFT JOIN checkin_count k ON k.business_id = c.business_id""")

_NORM = "CASE WHEN MAX({c}) OVER () <= MIN({c}) OVER () THEN 0.0 ELSE ({c} - MIN({c}) OVER ()) / (MAX({c}) OVER () - MIN({c}) OVER ()) END"

_view("biz_prior", ("prior_feats",), f"""
SELECT business_id, name, city, state, address, latitude, longitude, is_open, categories, attributes,
       review_count, stars, soup, tip_count, checkin_count,
       CAST({K.PRIOR_W_REVIEWS} * {_NORM.format(c='f_rev')} + {K.PRIOR_W_STARS} * {_NORM.format(c='f_star')}
          + {K.PRIOR_W_TIPS} * {_NORM.format(c='f_tip')} + {K.PRIOR_W_CHECKINS} * {_NORM.format(c='f_chk')} AS DOUBLE)
         AS popularity_prior
FROM prior_feats""")

_view("local_log", (), """
SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS business_id,
       GREATEST(1.0, LEAST(5.0, value / 20.0)) AS stars, ts AS date, 'local' AS source
FROM events WHERE event_type = 'purchase'""")

_view("request_events", (), """
SELECT ts, CAST(user_id AS VARCHAR) AS user_id, event_type AS algorithm, 10 AS k, value AS latency_ms, 'api' AS source
FROM events""")

_view("user_counts", ("interactions",), """
SELECT user_id, COUNT(*) AS n_hist FROM interactions GROUP BY user_id""")

_view("stop_words", (), f"""SELECT unnest([{_STOP}]) AS w""")


#: Small views over the user x item ones, named more than once in a statement: computed once.
MATERIALIZED = {"hy_top"}


def with_views(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        deps, _ = VIEWS[n]
        for d in deps:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' * (n in MATERIALIZED)}({VIEWS[n][1].strip()}\n)" for n in order)
    return f"WITH {ctes}\n{body.strip()}"


STOP_WORDS_SQL = _STOP


def fixed_sql(expr: str, n: int) -> str:
    """SQL twin of ``functions.exprs.fixed``."""
    scale = 10 ** n
    s = f"CAST(floor(({expr}) * {float(scale)} + 0.5) AS BIGINT)"
    return f"(CAST({s} // {scale} AS VARCHAR) || '.' || lpad(CAST({s} % {scale} AS VARCHAR), {n}, '0'))"


def _tfidf_views(prefix: str, docs_sql: str, deps: tuple[str, ...]) -> None:
    """M1-M3 for one corpus: {prefix}_docs(business_id, soup) -> {prefix}_tfidf(business_id, term, weight)."""
    _view(f"{prefix}_docs", deps, docs_sql)
    _view(f"{prefix}_toks", (f"{prefix}_docs",), f"""
SELECT business_id, list_filter(regexp_extract_all(lower(COALESCE(soup, '')), '{K.TOKEN_PATTERN_RE2}'),
                                lambda x: NOT list_contains([{_STOP}], x)) AS t
FROM {prefix}_docs""")
    _view(f"{prefix}_terms", (f"{prefix}_toks",), f"""
SELECT business_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS terms
FROM {prefix}_toks""")
    _view(f"{prefix}_tf", (f"{prefix}_terms",), f"""
SELECT business_id, term, COUNT(*) AS tf FROM (SELECT business_id, unnest(terms) AS term FROM {prefix}_terms)
GROUP BY business_id, term""")
    _view(f"{prefix}_stats", (f"{prefix}_tf",), f"""
SELECT term, COUNT(*) AS df, CAST(SUM(tf) AS BIGINT) AS tf FROM {prefix}_tf GROUP BY term""")
    _view(f"{prefix}_vocab", (f"{prefix}_stats",), f"""
SELECT term, df, tf FROM {prefix}_stats
WHERE df >= CASE WHEN (SELECT MAX(df) FROM {prefix}_stats) >= {K.MIN_DF} THEN {K.MIN_DF} ELSE 1 END
ORDER BY tf DESC, term LIMIT {K.MAX_FEATURES}""")
    _view(f"{prefix}_tfidf", (f"{prefix}_vocab", f"{prefix}_tf", f"{prefix}_docs"), f"""
SELECT business_id, term, w / sqrt(SUM(w * w) OVER (PARTITION BY business_id)) AS weight FROM (
  SELECT t.business_id, t.term,
         t.tf * (ln((1.0 + (SELECT COUNT(*) FROM {prefix}_docs)) / (1.0 + v.df)) + 1.0) AS w
  FROM {prefix}_tf t JOIN {prefix}_vocab v ON v.term = t.term)""")


_tfidf_views("cat", "SELECT business_id, soup FROM catalogue", ("catalogue",))
_tfidf_views("doc", "SELECT CAST(doc_id AS VARCHAR) AS business_id, text AS soup FROM documents", ())

# CF: rating table (A8), biases (A9), given factors.
_view("ratings", ("interactions",), """
SELECT user_id, business_id, AVG(stars) AS stars FROM interactions
WHERE user_id IS NOT NULL AND business_id IS NOT NULL AND stars IS NOT NULL GROUP BY user_id, business_id""")
_view("mu", ("ratings",), "SELECT AVG(stars) AS mu FROM ratings")
_view("ubias", ("ratings", "mu"), """
SELECT user_id, AVG(stars) - (SELECT mu FROM mu) AS bias FROM ratings GROUP BY user_id""")
_view("ibias", ("ratings", "mu"), """
SELECT business_id, AVG(stars) - (SELECT mu FROM mu) AS bias FROM ratings GROUP BY business_id""")
_view("ufac", ("ratings",), """
SELECT u.user_id, CAST(e.embedding AS DOUBLE[]) AS f
FROM (SELECT DISTINCT user_id FROM ratings) u
JOIN embeddings e ON e.vec_id = CAST(u.user_id AS BIGINT) % (SELECT COUNT(*) FROM embeddings)""")
_view("ifac", ("ratings",), """
SELECT i.business_id, CAST(e.embedding AS DOUBLE[]) AS f
FROM (SELECT DISTINCT business_id FROM ratings) i
JOIN embeddings e ON e.vec_id = CAST(i.business_id AS BIGINT) % (SELECT COUNT(*) FROM embeddings)""")

# History order: date ascending (nulls last), then business_id.
_view("hist", ("interactions",), """
SELECT user_id, business_id, stars, date,
       ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY date ASC NULLS LAST, business_id) AS pos,
       COUNT(*) OVER (PARTITION BY user_id) AS n_hist
FROM interactions""")

# Content profile with raw ratings as weights (the "content" algorithm) and its norm.
_view("prof_raw", ("hist", "cat_tfidf"), """
SELECT h.user_id, x.term, SUM(h.w * x.weight) / MAX(h.wsum) AS weight FROM (
  SELECT user_id, business_id, w, SUM(w) OVER (PARTITION BY user_id) AS wsum FROM (
    SELECT user_id, business_id, CASE WHEN tot > 0 THEN stars ELSE 1.0 END AS w FROM (
      SELECT user_id, business_id, stars, SUM(stars) OVER (PARTITION BY user_id) AS tot
      FROM hist WHERE business_id IN (SELECT business_id FROM cat_tfidf)))) h
JOIN cat_tfidf x ON x.business_id = h.business_id
GROUP BY h.user_id, x.term""")

# Hybrid (H1-H7) on the given factors.
_view("hw", ("hist",), f"""
SELECT user_id, business_id, stars, date, pos, n_hist, n_hist - pos AS steps,
       CASE WHEN SUM(w) OVER (PARTITION BY user_id) > 0 THEN w ELSE rec END AS weight
FROM (SELECT *, exp(-(n_hist - pos) / {K.RECENCY_E_FOLD}) AS rec,
             exp(-(n_hist - pos) / {K.RECENCY_E_FOLD}) * GREATEST(0.0, (stars - 1.0) / 4.0) AS w FROM hist)""")
_view("prof_h2", ("hw", "cat_tfidf"), """
SELECT h.user_id, x.term, SUM(h.w * x.weight) / MAX(h.wsum) AS weight FROM (
  SELECT user_id, business_id, w, SUM(w) OVER (PARTITION BY user_id) AS wsum FROM (
    SELECT user_id, business_id, CASE WHEN tot > 0 THEN weight ELSE 1.0 END AS w FROM (
      SELECT user_id, business_id, weight, SUM(weight) OVER (PARTITION BY user_id) AS tot
      FROM hw WHERE business_id IN (SELECT business_id FROM cat_tfidf)))) h
JOIN cat_tfidf x ON x.business_id = h.business_id
GROUP BY h.user_id, x.term""")
_view("prior_clip", ("biz_prior",), """
SELECT business_id, LEAST(1.0, GREATEST(0.0, COALESCE(popularity_prior, 0.0))) AS prior FROM biz_prior""")
_view("alpha_u", ("interactions",), f"""
SELECT user_id, COUNT(*) AS n_history,
       LEAST(1.0, GREATEST({K.MIN_ALPHA}, {K.MIN_ALPHA} + {1 - K.MIN_ALPHA} * exp(-GREATEST(COUNT(*), 0) / {K.ALPHA_E_FOLD}))) AS alpha
FROM interactions GROUP BY user_id""")
# Every (user, catalogue item) with all blend components; hist = already in the history.
_view("hy_all", ("prof_h2", "catalogue", "cat_tfidf", "mu", "ubias", "ibias", "ufac", "ifac", "prior_clip",
                 "alpha_u", "interactions"), """
SELECT u.user_id, c.business_id, u.alpha,
       CASE WHEN pn.pnorm > 0 THEN COALESCE(d.dot, 0.0) / pn.pnorm ELSE 0.0 END AS content,
       pn.user_id IS NOT NULL AS has_profile,
       CASE WHEN ib.bias IS NOT NULL THEN LEAST(5.0, GREATEST(1.0, (SELECT mu FROM mu) + ib.bias
            + CASE WHEN ub.bias IS NOT NULL THEN ub.bias + list_inner_product(uf.f, xf.f) ELSE 0.0 END)) END AS cf4,
       LEAST(5.0, GREATEST(1.0, (SELECT mu FROM mu) + COALESCE(ub.bias, 0.0) + COALESCE(ib.bias, 0.0)
            + CASE WHEN ub.bias IS NOT NULL AND ib.bias IS NOT NULL AND uf.f IS NOT NULL AND xf.f IS NOT NULL
                   THEN list_inner_product(uf.f, xf.f) ELSE 0.0 END)) AS cf3,
       COALESCE(pc.prior, 0.0) AS prior,
       EXISTS (SELECT 1 FROM interactions i WHERE i.user_id = u.user_id AND i.business_id = c.business_id) AS hist
FROM alpha_u u CROSS JOIN catalogue c
LEFT JOIN (SELECT user_id, sqrt(SUM(weight * weight)) AS pnorm FROM prof_h2 GROUP BY user_id) pn ON pn.user_id = u.user_id
LEFT JOIN (SELECT p.user_id, x.business_id, SUM(p.weight * x.weight) AS dot
           FROM prof_h2 p JOIN cat_tfidf x ON x.term = p.term GROUP BY 1, 2) d
       ON d.user_id = u.user_id AND d.business_id = c.business_id
LEFT JOIN ubias ub ON ub.user_id = u.user_id LEFT JOIN ibias ib ON ib.business_id = c.business_id
LEFT JOIN ufac uf ON uf.user_id = u.user_id LEFT JOIN ifac xf ON xf.business_id = c.business_id
LEFT JOIN prior_clip pc ON pc.business_id = c.business_id""")
_view("hy_cand", ("hy_all",), f"""
SELECT *, {1 - K.PRIOR_WEIGHT} * (alpha * content + (1 - alpha) * LEAST(1.0, GREATEST(0.0, (cf3 - 1.0) / 4.0)))
          + {K.PRIOR_WEIGHT} * prior AS score
FROM (
  SELECT *,
    CASE WHEN cf4 IS NOT NULL AND NOT hist THEN ROW_NUMBER() OVER (PARTITION BY user_id, (cf4 IS NOT NULL AND NOT hist)
         ORDER BY ROUND(cf4, 6) DESC, business_id) END AS cf_rank,
    CASE WHEN has_profile AND NOT hist THEN ROW_NUMBER() OVER (PARTITION BY user_id, (has_profile AND NOT hist)
         ORDER BY ROUND(content, 6) DESC, business_id) END AS ct_rank,
    DENSE_RANK() OVER (ORDER BY ROUND(prior, 6) DESC, business_id) AS pr_rank
  FROM hy_all)
WHERE NOT hist AND (cf_rank <= {K.CF_CANDIDATES} OR ct_rank <= {K.CONTENT_CANDIDATES} OR pr_rank <= {K.PRIOR_CANDIDATES})""")

# Unweighted (mean) content profile, used by the full-catalogue content ranking.
_view("prof_mean", ("hist", "cat_tfidf"), """
SELECT h.user_id, x.term, SUM(x.weight) / MAX(h.cnt) AS weight FROM (
  SELECT user_id, business_id, COUNT(*) OVER (PARTITION BY user_id) AS cnt
  FROM hist WHERE business_id IN (SELECT business_id FROM cat_tfidf)) h
JOIN cat_tfidf x ON x.business_id = h.business_id
GROUP BY h.user_id, x.term""")
_view("ct_mean_all", ("prof_mean", "catalogue", "cat_tfidf", "interactions"), """
SELECT u.user_id, c.business_id,
       CASE WHEN u.pnorm > 0 THEN COALESCE(d.dot, 0.0) / u.pnorm ELSE 0.0 END AS score
FROM (SELECT user_id, sqrt(SUM(weight * weight)) AS pnorm FROM prof_mean GROUP BY user_id) u
CROSS JOIN (SELECT business_id FROM catalogue) c
LEFT JOIN (SELECT p.user_id, x.business_id, SUM(p.weight * x.weight) AS dot
           FROM prof_mean p JOIN cat_tfidf x ON x.term = p.term GROUP BY 1, 2) d
       ON d.user_id = u.user_id AND d.business_id = c.business_id
WHERE NOT EXISTS (SELECT 1 FROM interactions i WHERE i.user_id = u.user_id AND i.business_id = c.business_id)""")
_view("cf_all", ("mu", "ubias", "ibias", "ufac", "ifac", "ratings"), """
SELECT ub.user_id, ib.business_id,
       LEAST(5.0, GREATEST(1.0, (SELECT mu FROM mu) + ub.bias + ib.bias + list_inner_product(uf.f, xf.f))) AS score
FROM ubias ub JOIN ufac uf ON uf.user_id = ub.user_id
CROSS JOIN ibias ib JOIN ifac xf ON xf.business_id = ib.business_id
WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = ub.user_id AND r.business_id = ib.business_id)""")
# Per-user top-5 categories (A14): count desc, then first position in the history.
_view("user_cats", ("hist", "catalogue"), """
SELECT user_id, category, cat_count, cat_rank FROM (
  SELECT user_id, category, cat_count,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY cat_count DESC, first_pos, first_cpos) AS cat_rank
  FROM (SELECT user_id, category, COUNT(*) AS cat_count, arg_min(pos, pos * 1000 + cpos) AS first_pos,
               arg_min(cpos, pos * 1000 + cpos) AS first_cpos
        FROM (SELECT h.user_id, h.pos, c.business_id, trim(s.cat) AS category, s.cpos
              FROM hist h JOIN catalogue c ON c.business_id = h.business_id,
              LATERAL (SELECT unnest(string_split(COALESCE(c.categories, ''), ',')) AS cat,
                              generate_subscripts(string_split(COALESCE(c.categories, ''), ','), 1) AS cpos) s
              WHERE trim(s.cat) <> '')
        GROUP BY user_id, category))
WHERE cat_rank <= 5""")

_view("ct_raw_top", ("prof_raw", "catalogue", "cat_tfidf", "interactions"), """
SELECT user_id, business_id, score, rank FROM (
  SELECT user_id, business_id, ROUND(score, 6) AS score,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ROUND(score, 6) DESC, business_id) AS rank
  FROM (
    SELECT u.user_id, c.business_id,
           CASE WHEN u.pnorm > 0 THEN COALESCE(d.dot, 0.0) / u.pnorm ELSE 0.0 END AS score
    FROM (SELECT user_id, sqrt(SUM(weight * weight)) AS pnorm FROM prof_raw GROUP BY user_id) u
    CROSS JOIN (SELECT business_id FROM catalogue) c
    LEFT JOIN (SELECT p.user_id, x.business_id, SUM(p.weight * x.weight) AS dot
               FROM prof_raw p JOIN cat_tfidf x ON x.term = p.term GROUP BY 1, 2) d
           ON d.user_id = u.user_id AND d.business_id = c.business_id
    WHERE NOT EXISTS (SELECT 1 FROM interactions i WHERE i.user_id = u.user_id AND i.business_id = c.business_id)))
WHERE rank <= 10""")
_view("cf_top", ("cf_all",), """
SELECT user_id, business_id, score, rank FROM (
  SELECT user_id, business_id, ROUND(score, 6) AS score,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ROUND(score, 6) DESC, business_id) AS rank FROM cf_all)
WHERE rank <= 10""")
_view("hy_top", ("hy_cand",), """
SELECT user_id, business_id, score, rank, content, cf3, alpha FROM (
  SELECT user_id, business_id, ROUND(score, 6) AS score, content, cf3, alpha,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ROUND(score, 6) DESC, business_id) AS rank FROM hy_cand)
WHERE rank <= 10""")


def clone_chain(prefix: str, names: tuple[str, ...], source_from: str, source_to: str) -> None:
    """Register a copy of the views ``names`` with every reference to a chain view (and the
    source table) renamed, e.g. the hybrid chain re-targeted at the training split."""
    import re
    mapping = {n: prefix + n for n in names}
    mapping[source_from] = source_to
    pat = re.compile(r"\b(" + "|".join(sorted(map(re.escape, mapping), key=len, reverse=True)) + r")\b")
    for n in names:
        deps, sql = VIEWS[n]
        new_deps = tuple(mapping.get(d, d) for d in deps)
        if source_from in deps:
            new_deps = tuple(source_to if d == source_from else d for d in new_deps)
        _view(prefix + n, new_deps, pat.sub(lambda m: mapping[m.group(1)], sql))


# Temporal leave-last-1 split (users with fewer than min_history + 1 rows dropped).
_view("split", ("hist",), f"""
SELECT user_id, business_id, stars, date, pos, n_hist,
       CASE WHEN pos > n_hist - 1 THEN 'test' ELSE 'train' END AS split
FROM hist WHERE n_hist >= {K.MIN_USER_REVIEWS} + 1""")
_view("train", ("split",), "SELECT user_id, business_id, stars, date FROM split WHERE split = 'train'")
_view("test", ("split",), "SELECT user_id, business_id, stars, date FROM split WHERE split = 'test'")
_view("relevant", ("test",), f"SELECT user_id, business_id FROM test WHERE stars >= {K.RELEVANCE_THRESHOLD}")

clone_chain("tr_", ("ratings", "mu", "ubias", "ibias", "ufac", "ifac", "hist", "hw", "prof_h2", "alpha_u",
                    "hy_all", "hy_cand", "hy_top"), "interactions", "train")

# Evaluation (E1-E8) on the given factors, CF biases refit on the training split.
_view("eval_users", ("relevant", "train"), """
SELECT DISTINCT user_id FROM relevant WHERE user_id IN (SELECT user_id FROM train)""")
_view("eval_recs", ("tr_hy_top", "eval_users"), """
SELECT * FROM tr_hy_top WHERE user_id IN (SELECT user_id FROM eval_users)""")


def metric_sql(recs: str, rel: str = "relevant", k: int = 10) -> str:
    return f"""
SELECT p.user_id, p.hits / {float(k)} AS precision, p.hits / n.n_rel AS recall,
       CASE WHEN idcg > 0 THEN p.dcg / idcg ELSE 0.0 END AS ndcg,
       CASE WHEN p.hits > 0 THEN 1.0 ELSE 0.0 END AS hit_rate
FROM (SELECT r.user_id, SUM(CASE WHEN x.business_id IS NOT NULL AND r.rank <= {k} THEN 1 ELSE 0 END) AS hits,
             SUM(CASE WHEN x.business_id IS NOT NULL AND r.rank <= {k} THEN 1.0 / log2(r.rank + 1) ELSE 0.0 END) AS dcg
      FROM {recs} r
      LEFT JOIN {rel} x ON x.user_id = r.user_id AND x.business_id = r.business_id
      GROUP BY r.user_id) p
JOIN (SELECT user_id, COUNT(*) AS n_rel,
             list_sum(list_transform(range(1, LEAST({k}, COUNT(*)) + 1), lambda i: 1.0 / log2(i + 1))) AS idcg
      FROM {rel} GROUP BY user_id) n ON n.user_id = p.user_id"""


_view("per_user_full", ("eval_recs", "relevant"), metric_sql("eval_recs"))
_view("neg_excl", ("train", "relevant", "eval_users"), """
SELECT DISTINCT user_id, business_id FROM (SELECT user_id, business_id FROM train UNION ALL
                                           SELECT user_id, business_id FROM relevant)
WHERE user_id IN (SELECT user_id FROM eval_users)""")
_view("neg_dom", ("tr_ratings",), """
SELECT nu.n, f.a, f.b FROM (SELECT COUNT(DISTINCT business_id) AS n FROM tr_ratings) nu,
  LATERAL (SELECT g.a, (nu.n + g.a - 1) // g.a AS b
           FROM (SELECT unnest(range(ceil(sqrt(nu.n))::BIGINT, 2 * ceil(sqrt(nu.n))::BIGINT + 1)) AS a) g
           ORDER BY g.a * ((nu.n + g.a - 1) // g.a) - nu.n, g.a LIMIT 1) f""")
_view("negatives", ("tr_ratings", "neg_excl", "eval_users", "neg_dom"), f"""
SELECT user_id, business_id FROM (
  SELECT s.user_id, pm.business_id, ROW_NUMBER() OVER (PARTITION BY s.user_id ORDER BY s.j) AS r
  FROM (SELECT u.user_id, j, {sql_permuted("j", "u.k", "u.n", "u.a", "u.b")} AS p FROM (
          SELECT e.user_id, COALESCE(x.ne, 0) AS ne, d.n, d.a, d.b, md5('{K.SEED}|' || e.user_id) AS k
          FROM eval_users e CROSS JOIN neg_dom d
          LEFT JOIN (SELECT user_id, COUNT(*) AS ne FROM neg_excl GROUP BY user_id) x ON x.user_id = e.user_id) u,
        LATERAL (SELECT unnest(range(0, LEAST(u.n, {K.N_NEGATIVES} + u.ne))) AS j)) s
  JOIN (SELECT business_id, ROW_NUMBER() OVER (ORDER BY business_id) - 1 AS p
        FROM (SELECT DISTINCT business_id FROM tr_ratings)) pm ON pm.p = s.p
  WHERE NOT EXISTS (SELECT 1 FROM neg_excl x WHERE x.user_id = s.user_id AND x.business_id = pm.business_id))
WHERE r <= {K.N_NEGATIVES}""")
_view("sampled_recs", ("negatives", "relevant", "tr_hy_all"), f"""
SELECT user_id, business_id, score, rank FROM (
  SELECT c.user_id, c.business_id, ROUND(a.score, 6) AS score,
         ROW_NUMBER() OVER (PARTITION BY c.user_id ORDER BY ROUND(a.score, 6) DESC, c.business_id) AS rank
  FROM (SELECT user_id, business_id FROM relevant WHERE user_id IN (SELECT user_id FROM negatives)
        UNION SELECT user_id, business_id FROM negatives) c
  JOIN (SELECT user_id, business_id,
               {1 - K.PRIOR_WEIGHT} * (alpha * content + (1 - alpha) * LEAST(1.0, GREATEST(0.0, (cf3 - 1.0) / 4.0)))
               + {K.PRIOR_WEIGHT} * prior AS score FROM tr_hy_all) a
    ON a.user_id = c.user_id AND a.business_id = c.business_id)
WHERE rank <= 10""")
_view("per_user_sampled", ("sampled_recs", "relevant"), metric_sql("sampled_recs"))
