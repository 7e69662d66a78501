"""Content model: tokens, vocabulary, TF-IDF, similarities, profiles.

Item vectors are kept as a long table ``(business_id, term, weight)`` with one
row per non-zero weight; every row is L2-normalised per business.

Partitioning: texts are hash-partitioned by document once.  The per-document
term counts and the per-document norm then run without another exchange
(both are clustered by the document key); only the document-frequency
aggregate shuffles, by term, after partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastegrid import constants as K
from tastegrid.session import cut_lineage

#: Rows of history whose vectors one task unfolds.
PROFILE_ROWS = 100_000
#: Characters of text whose words and pairs of words one task unfolds.
TEXT_CHARS = 4_000_000


def tokens(text: Column) -> Column:
    """M1 unigrams: lower-cased runs of >= 2 word characters, English stop words removed."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(K.TOKEN_PATTERN), 0)
    return F.filter(raw, lambda t: ~t.isin(*K.STOP_WORDS))


def bigrams(toks: Column) -> Column:
    """M1 bigrams of consecutive kept tokens (built after stop-word removal)."""
    n = F.greatest(F.size(toks) - 1, F.lit(0))
    return F.zip_with(F.slice(toks, 1, n), F.slice(toks, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def terms(text: Column, ngram_max: int = 2) -> Column:
    toks = tokens(text)
    return F.concat(toks, bigrams(toks)) if ngram_max >= 2 else toks


def _parts(df: DataFrame, size: int, each: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // each))


def term_counts(docs: DataFrame, id_col: str = "business_id", text_col: str = "soup",
                ngram_max: int = 2) -> DataFrame:
    """(id, term, tf) for every document; clustered by document id."""
    texts = docs.select(F.col(id_col).alias("business_id"), F.col(text_col).alias("_text"))
    # dealt out by what the texts unfold to: partitions sized by the packed texts outgrow a task's memory
    chars = texts.agg(F.sum(F.length("_text"))).first()[0] or 0
    return (texts.repartition(_parts(docs, chars, TEXT_CHARS), "business_id")
            .select("business_id", F.explode(terms(F.col("_text"), ngram_max)).alias("term"))
            .groupBy("business_id", "term").agg(F.count(F.lit(1)).alias("tf")))


def vocabulary(tf: DataFrame, min_df: int = K.MIN_DF, max_features: int | None = K.MAX_FEATURES) -> DataFrame:
    """M2: terms with df >= min_df (retried with 1 when none survive), top max_features by corpus count.

    Ties in corpus count are broken by term.  The retry is a scalar subquery,
    not a driver round trip.
    """
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")).persist(StorageLevel.MEMORY_AND_DISK)
    top_df = stats.agg(F.max("df")).scalar()
    eff_min = F.when(top_df >= min_df, F.lit(min_df)).otherwise(F.lit(1))
    vocab = stats.filter(F.col("df") >= eff_min)
    if max_features is not None:
        vocab = vocab.orderBy(F.col("tf").desc(), F.col("term").asc()).limit(max_features)
    return vocab


def tfidf(docs: DataFrame, id_col: str = "business_id", text_col: str = "soup", min_df: int = K.MIN_DF,
          max_features: int | None = K.MAX_FEATURES, ngram_max: int = 2) -> tuple[DataFrame, DataFrame]:
    """M3: weight = tf * (ln((1 + n) / (1 + df)) + 1), L2-normalised per document.

    Returns (item_tfidf, vocabulary-with-idf).  n counts every document row,
    also empty ones.  The vocabulary is at most ``max_features`` rows, which
    bounds the broadcast.
    """
    # kept: texts are cut into terms once, for the vocabulary and for the weights, and stay dealt out by document
    tf = term_counts(docs, id_col, text_col, ngram_max).persist(StorageLevel.MEMORY_AND_DISK)
    vocab = vocabulary(tf, min_df, max_features)
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    vocab = vocab.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
    vocab_side = F.broadcast(vocab.select("term", "idf")) if max_features is not None else vocab.select("term", "idf")
    w = tf.join(vocab_side, "term").select("business_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("business_id")))
    item = w.select("business_id", "term", (F.col("w") / norm).alias("weight"))
    return item, vocab


def packed_items(item_tfidf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(business_id, t_idx, t_val) with one row per item, and the (term, tid) of its ids; both written once.

    Expects one row per (business_id, term).
    """
    ids = cut_lineage(vocab_index(item_tfidf.select("term").distinct()), "terms")
    return cut_lineage(sparse_item_arrays(item_tfidf, ids), "items"), ids


def _pair_dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last four columns, the sorted sparse vectors of two items, give way to their dot product."""
    for b in batches:
        ia, va, ib, vb = b.columns[-4:]
        keys = []
        for idx in (ia, ib):
            row = np.repeat(np.arange(b.num_rows, dtype=np.int64), pc.list_value_length(idx).fill_null(0).to_numpy(zero_copy_only=False))
            keys.append(row << 32 | idx.flatten().to_numpy(zero_copy_only=False))
        x, y = (v.flatten().to_numpy(zero_copy_only=False) for v in (va, vb))
        out = np.zeros(b.num_rows)
        if len(keys[0]) and len(keys[1]):
            at = np.minimum(np.searchsorted(keys[1], keys[0]), len(keys[1]) - 1)
            hit = keys[1][at] == keys[0]
            out = np.bincount(keys[0][hit] >> 32, weights=x[hit] * y[at[hit]], minlength=b.num_rows)
        yield pa.RecordBatch.from_arrays([*b.columns[:-4], pa.array(out, pa.float64())], names=[*b.schema.names[:-4], "similarity"])


def pair_similarity(item_tfidf: DataFrame, pairs: DataFrame, a: str = "business_a", b: str = "business_b") -> DataFrame:
    """M4: cosine of two items (vectors are unit length); unknown ids or no shared term -> 0.

    Each pair takes both items' vectors along, packed: rows stay as many as pairs until the products are summed.
    """
    items, _ = packed_items(item_tfidf)
    out = pairs
    for key, side in ((a, "a"), (b, "b")):
        # one row per item: the side to hash, so that the wide rows of the pairs need no sort
        vec = items.select(F.col("business_id").alias(f"_of_{side}"), F.col("t_idx").alias(f"_i{side}"), F.col("t_val").alias(f"_v{side}"))
        out = out.join(vec.hint("shuffle_hash"), F.col(key) == F.col(f"_of_{side}"), "left").drop(f"_of_{side}")
    schema = T.StructType([*pairs.schema.fields, T.StructField("similarity", T.DoubleType())])
    return out.select(*pairs.columns, "_ia", "_va", "_ib", "_vb").mapInArrow(_pair_dots, schema)


def user_profiles(history: DataFrame, item_tfidf: DataFrame, weight_col: str | None = None) -> DataFrame:
    """M5: weighted mean of the history's item vectors -> (user_id, term, weight).

    History repeats count.  Users whose history resolves to nothing (J18) get no rows.  The given weights count unless they are
    missing or sum to <= 0 over the resolved rows; then every resolved row weighs 1 (plain mean).

    Item vectors travel packed to their users and are unfolded there, in as many partitions as the rows ask for: unfolded before
    the shuffle, or in partitions sized by the packed rows, the sums outgrow a task's memory.
    """
    items, ids = packed_items(item_tfidf)
    weight = F.lit(1.0) if weight_col is None else F.col(weight_col).cast("double")
    h = history.where("user_id IS NOT NULL").select("user_id", "business_id", weight.alias("_w"))
    parts = _parts(h, h.count(), PROFILE_ROWS)
    # each vector gets an entry more, whose sums are the weights and the number of the rows
    entry = F.arrays_zip(F.concat("t_idx", F.array(F.lit(-1))).alias("tid"), F.concat("t_val", F.array(F.lit(1.0))).alias("x"))
    sums = (h.join(items, "business_id").select("user_id", "_w", "t_idx", "t_val").repartition(parts, "user_id")
            .select("user_id", "_w", F.inline(entry).alias("tid", "x"))
            .groupBy("user_id", "tid").agg(F.sum(F.col("_w") * F.col("x")).alias("_s"), F.sum("x").alias("_plain")))
    user = Window.partitionBy("user_id")
    sums = sums.withColumns({"_total": F.max(F.when(F.col("tid") < 0, F.col("_s"))).over(user),
                             "_n": F.max(F.when(F.col("tid") < 0, F.col("_plain"))).over(user)})
    value = F.when(F.col("_total") > 0, F.col("_s") / F.col("_total")).otherwise(F.col("_plain") / F.col("_n"))
    return sums.join(ids, "tid").select("user_id", "term", value.alias("weight"))


def profile_norms(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("user_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("pnorm"))


def score_pairs(profiles: DataFrame, item_tfidf: DataFrame, pairs: DataFrame) -> DataFrame:
    """M6 for explicit (user_id, business_id) pairs: cos(profile, item); zero profile or no overlap -> 0.

    Linear in pairs x item terms; used for candidate sets, not the full catalogue.
    """
    keys = pairs.select("user_id", "business_id").distinct()
    # of the profiles only those of the pairs' users are moved
    profiles = profiles.join(keys.select("user_id").distinct(), "user_id", "left_semi")
    p = profiles.select("user_id", "term", F.col("weight").alias("_p"))
    dots = (keys.join(item_tfidf.select("business_id", "term", F.col("weight").alias("_x")), "business_id")
            .join(p, ["user_id", "term"])
            .groupBy("user_id", "business_id").agg(F.sum(F.col("_p") * F.col("_x")).alias("_dot")))
    norms = profile_norms(profiles)
    return (pairs.join(dots, ["user_id", "business_id"], "left").join(norms, "user_id", "left")
            .withColumn("content_score",
                        F.when(F.col("pnorm") > 0, F.coalesce(F.col("_dot"), F.lit(0.0)) / F.col("pnorm"))
                        .otherwise(F.lit(0.0)))
            .drop("_dot", "pnorm"))


def sparse_profile_arrays(profiles: DataFrame, vocab_index: DataFrame) -> DataFrame:
    """(user_id, p_idx array<int>, p_val array<double>) for the block scorer; one row per user."""
    return (profiles.join(vocab_index, "term")
            .groupBy("user_id")
            .agg(F.sort_array(F.collect_list(F.struct(F.col("tid"), F.col("weight")))).alias("_e"))
            .select("user_id", F.col("_e.tid").alias("p_idx"), F.col("_e.weight").alias("p_val")))


def sparse_item_arrays(item_tfidf: DataFrame, vocab_index: DataFrame) -> DataFrame:
    """(business_id, t_idx array<int>, t_val array<double>); one row per item."""
    return (item_tfidf.join(vocab_index, "term")
            .groupBy("business_id")
            .agg(F.sort_array(F.collect_list(F.struct(F.col("tid"), F.col("weight")))).alias("_e"))
            .select("business_id", F.col("_e.tid").alias("t_idx"), F.col("_e.weight").alias("t_val")))


def vocab_index(vocab: DataFrame) -> DataFrame:
    """Dense integer ids for the (bounded) vocabulary, in term order."""
    return vocab.select("term", (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("tid"))
