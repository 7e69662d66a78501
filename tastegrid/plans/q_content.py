"""Content-model queries."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from tastegrid.functions.exprs import round6
from tastegrid.operators import content
from tastegrid.operators.blocked import ScoreSpec, grid_top_k
from tastegrid.operators.positions import with_positions_by_key
from tastegrid.plans.context import Ctx
from tastegrid.plans.registry import query
from tastegrid.plans.sql_views import with_views
from tastegrid.session import cut_lineage
from tastegrid.sources.tables import read_table


def catalogue_tfidf(c: Ctx):
    """Item TF-IDF over the catalogue text, cached on the context."""
    if not hasattr(c, "_tfidf"):
        item, vocab = content.tfidf(c.catalogue, "business_id", "soup")
        c._tfidf = (item.persist(StorageLevel.MEMORY_AND_DISK), vocab.persist(StorageLevel.MEMORY_AND_DISK))
    return c._tfidf


def history_pairs(c: Ctx):
    """(user_id, business_a, business_b): neighbours in the users' histories by date (nulls last), then business_id."""
    h = with_positions_by_key(c.interactions, ["user_id"], [F.col("date").asc_nulls_last(), F.col("business_id")], "pos", previous=("business_id", "business_a"))
    return h.where("pos > 1").select("user_id", "business_a", F.col("business_id").alias("business_b"))


@query("tokens_ngrams", "M1", with_views("""
SELECT business_id, CAST(len(t) AS BIGINT) AS n_unigrams, CAST(len(terms) - len(t) AS BIGINT) AS n_bigrams,
       array_to_string(terms, '|') AS terms
FROM cat_terms JOIN cat_toks USING (business_id)""", "cat_terms", "cat_toks"))
def tokens_ngrams(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    t = content.tokens(F.col("soup"))
    return (c.catalogue.select("business_id", t.alias("t"))
            .select("business_id", F.size("t").cast("bigint").alias("n_unigrams"),
                    F.size(content.bigrams(F.col("t"))).cast("bigint").alias("n_bigrams"),
                    F.array_join(F.concat(F.col("t"), content.bigrams(F.col("t"))), "|").alias("terms")))


@query("vocabulary", "M2", with_views("SELECT term, df, tf FROM cat_vocab", "cat_vocab"))
def vocabulary(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    tf = content.term_counts(c.catalogue, "business_id", "soup")
    return content.vocabulary(tf).select("term", "df", "tf")


@query("tfidf", "M3", with_views("SELECT business_id, term, ROUND(weight, 6) AS weight FROM cat_tfidf", "cat_tfidf"))
def tfidf(spark, sf_dir):
    item, _ = content.tfidf(Ctx(spark, sf_dir).catalogue, "business_id", "soup")
    return item.select("business_id", "term", round6("weight").alias("weight"))


@query("tfidf_documents", "M1-M3 on whole documents", with_views(
    "SELECT business_id AS doc_id, term, ROUND(weight, 6) AS weight FROM doc_tfidf", "doc_tfidf"))
def tfidf_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("business_id"),
                                                         F.col("text").alias("soup"))
    item, _ = content.tfidf(docs, "business_id", "soup")
    return item.select(F.col("business_id").alias("doc_id"), "term", round6("weight").alias("weight"))


@query("item_similarity", "M4, W2-style lag over history", with_views("""
SELECT p.user_id, p.business_a, p.business_b, ROUND(COALESCE(s.sim, 0.0), 6) AS similarity FROM (
  SELECT user_id, LAG(business_id) OVER (PARTITION BY user_id ORDER BY pos) AS business_a, business_id AS business_b
  FROM hist) p
LEFT JOIN (SELECT a.business_id AS ba, b.business_id AS bb, SUM(a.weight * b.weight) AS sim
           FROM cat_tfidf a JOIN cat_tfidf b ON a.term = b.term
           WHERE (a.business_id, b.business_id) IN (SELECT business_a, business_b FROM (
               SELECT LAG(business_id) OVER (PARTITION BY user_id ORDER BY pos) AS business_a, business_id AS business_b FROM hist))
           GROUP BY 1, 2) s ON s.ba = p.business_a AND s.bb = p.business_b
WHERE p.business_a IS NOT NULL""", "hist", "cat_tfidf"))
def item_similarity(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    item, _ = catalogue_tfidf(c)
    out = content.pair_similarity(item, history_pairs(c))
    return out.select("user_id", "business_a", "business_b", round6("similarity").alias("similarity"))


@query("user_profile_terms", "M5, J18", with_views(
    "SELECT user_id, term, ROUND(weight, 6) AS weight FROM prof_raw", "prof_raw"))
def user_profile_terms(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    item, _ = catalogue_tfidf(c)
    prof = content.user_profiles(c.interactions, item, "stars")
    return prof.select("user_id", "term", round6("weight").alias("weight"))


def content_scorer_inputs(c: Ctx, profiles):
    item, vocab = catalogue_tfidf(c)
    vidx = cut_lineage(content.vocab_index(vocab))
    users = content.sparse_profile_arrays(profiles, vidx)
    items = c.catalogue.select("business_id").join(content.sparse_item_arrays(item, vidx), "business_id", "left")
    return users, items


@query("content_topk", "M6, M7, W4", with_views("""
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
WHERE rank <= 10""", "prof_raw", "catalogue", "cat_tfidf", "interactions"))
def content_topk(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    item, vocab = catalogue_tfidf(c)
    seen = c.interactions.select("user_id", "business_id")
    prof = content.user_profiles(c.interactions, item, "stars")
    users, items = content_scorer_inputs(c, prof)
    out = grid_top_k(users, items, 10, ScoreSpec("content"), seen=seen)
    return out.select("user_id", "business_id", round6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))
