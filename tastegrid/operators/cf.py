"""Collaborative model: rating table, biases, residuals, predictions.

The model is a handful of tables -- global mean, ``user_bias``,
``item_bias``, ``user_factors``, ``item_factors`` (arrays of doubles) and the
seen pairs -- never dictionaries on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid import constants as K
from tastegrid.operators.blocked import ScoreSpec, grid_top_k
from tastegrid.operators.svd import MAX_STEPS, OVERSAMPLE, truncated_svd


def ratings(interactions: DataFrame, user_col: str = "user_id", item_col: str = "business_id",
            rating_col: str = "stars") -> DataFrame:
    """Drop rows with nulls, mean rating per (user, item), ids as strings."""
    return (interactions.select(F.col(user_col).cast("string").alias("user_id"),
                                F.col(item_col).cast("string").alias("business_id"),
                                F.col(rating_col).cast("double").alias("stars"))
            .dropna()
            .groupBy("user_id", "business_id").agg(F.avg("stars").alias("stars")))


@dataclass
class CFModel:
    mu: float
    user_bias: DataFrame      # user_id, bias
    item_bias: DataFrame      # business_id, bias
    user_factors: DataFrame | None = None   # user_id, factors array<double>
    item_factors: DataFrame | None = None   # business_id, factors array<double>
    seen: DataFrame | None = None           # user_id, business_id
    lo: float = K.MIN_RATING
    hi: float = K.MAX_RATING


def fit_biases(r: DataFrame) -> tuple[float, DataFrame, DataFrame]:
    """mu = mean rating; b_u = mean_u - mu; b_i = mean_i - mu (no shrinkage)."""
    r = r.persist(StorageLevel.MEMORY_AND_DISK)
    mu = r.agg(F.avg("stars")).first()[0]
    mu = float(mu) if mu is not None else 0.0
    # One row per user / item: model-sized tables read by every prediction.
    ub = r.groupBy("user_id").agg((F.avg("stars") - F.lit(mu)).alias("bias")).persist(StorageLevel.MEMORY_AND_DISK)
    ib = r.groupBy("business_id").agg((F.avg("stars") - F.lit(mu)).alias("bias")).persist(StorageLevel.MEMORY_AND_DISK)
    return mu, ub, ib


def residuals(r: DataFrame, mu: float, ub: DataFrame, ib: DataFrame) -> DataFrame:
    """A10: r - (mu + b_u + b_i)."""
    return (r.join(ub.withColumnRenamed("bias", "_bu"), "user_id")
            .join(ib.withColumnRenamed("bias", "_bi"), "business_id")
            .select("user_id", "business_id",
                    (F.col("stars") - (F.lit(mu) + F.col("_bu") + F.col("_bi"))).alias("residual")))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two equal-length double arrays, JVM-side."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def predict_pairs(model: CFModel, pairs: DataFrame) -> DataFrame:
    """Mu + b_u + b_i + p_u . q_i; an unknown user or item drops its terms; clipped.

    Adds ``cf_pred`` to ``pairs`` (user_id, business_id, ...).
    """
    out = (pairs.join(model.user_bias.withColumnRenamed("bias", "_bu"), "user_id", "left")
           .join(model.item_bias.withColumnRenamed("bias", "_bi"), "business_id", "left"))
    d = F.lit(0.0)
    if model.user_factors is not None and model.item_factors is not None:
        out = (out.join(model.user_factors.withColumnRenamed("factors", "_pu"), "user_id", "left")
               .join(model.item_factors.withColumnRenamed("factors", "_qi"), "business_id", "left"))
        d = F.when(F.col("_bu").isNotNull() & F.col("_bi").isNotNull() & F.col("_pu").isNotNull()
                   & F.col("_qi").isNotNull(), dot(F.col("_pu"), F.col("_qi"))).otherwise(F.lit(0.0))
    raw = F.lit(model.mu) + F.coalesce(F.col("_bu"), F.lit(0.0)) + F.coalesce(F.col("_bi"), F.lit(0.0)) + d
    out = out.withColumn("cf_pred", F.least(F.greatest(raw, F.lit(model.lo)), F.lit(model.hi)))
    return out.drop("_bu", "_bi", "_pu", "_qi")


def baseline_pairs(model: CFModel, pairs: DataFrame) -> DataFrame:
    """The bias-only prediction (what an unknown user or item receives), unclipped."""
    out = (pairs.join(model.user_bias.withColumnRenamed("bias", "_bu"), "user_id", "left")
           .join(model.item_bias.withColumnRenamed("bias", "_bi"), "business_id", "left"))
    return (out.withColumn("baseline", F.lit(model.mu) + F.coalesce(F.col("_bu"), F.lit(0.0))
                           + F.coalesce(F.col("_bi"), F.lit(0.0)))
            .drop("_bu", "_bi"))


def predict_candidates(model: CFModel, candidates: DataFrame) -> DataFrame:
    """C4: like C3, but candidates unknown to the model are dropped (inner join on item)."""
    known = candidates.join(model.item_bias.select("business_id"), "business_id", "left_semi")
    return predict_pairs(model, known)


def user_side(model: CFModel, users: DataFrame) -> DataFrame:
    """Scorer input for users: u_bias (null = unknown user) and u_vec."""
    out = users.select("user_id").distinct().join(model.user_bias.withColumnRenamed("bias", "u_bias"), "user_id", "left")
    if model.user_factors is not None:
        out = out.join(model.user_factors.withColumnRenamed("factors", "u_vec"), "user_id", "left")
    else:
        out = out.withColumn("u_vec", F.lit(None).cast("array<double>"))
    return out


def item_side(model: CFModel, items: DataFrame | None = None, keep_unknown: bool = False) -> DataFrame:
    """Scorer input for items: i_bias (null = unknown item) and i_vec."""
    base = model.item_bias.withColumnRenamed("bias", "i_bias")
    if items is not None:
        base = items.select("business_id").distinct().join(base, "business_id", "left" if keep_unknown else "inner")
    if model.item_factors is not None:
        base = base.join(model.item_factors.withColumnRenamed("factors", "i_vec"), "business_id", "left")
    else:
        base = base.withColumn("i_vec", F.lit(None).cast("array<double>"))
    return base


def recommend_top_k(model: CFModel, users: DataFrame, k: int = 10, exclude_seen: bool = True) -> DataFrame:
    """Top-k unseen items by predicted rating for every user; unknown users rank by item bias."""
    return grid_top_k(user_side(model, users), item_side(model), k,
                      ScoreSpec("cf", mu=model.mu, lo=model.lo, hi=model.hi),
                      seen=model.seen if exclude_seen else None)


def fit_given(interactions: DataFrame, user_factors: DataFrame | None, item_factors: DataFrame | None) -> CFModel:
    """C1 with fixed factors: biases from the data, factors supplied (used for SQL-checkable runs)."""
    r = ratings(interactions)
    mu, ub, ib = fit_biases(r)
    return CFModel(mu, ub, ib, user_factors, item_factors, r.select("user_id", "business_id"))


def effective_rank(n_components: int, n_users: int, n_items: int) -> int:
    """max(1, min(n_components, min(n_users, n_items) - 1))."""
    return max(1, min(n_components, min(n_users, n_items) - 1))


def fit_svd(spark, resid: DataFrame, n_components: int = K.N_COMPONENTS, n_iter: int = MAX_STEPS,
            oversample: int = OVERSAMPLE, seed: int = K.SEED) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Rank-r truncated SVD of the residual matrix (block Krylov, at most ``n_iter`` steps).

    Returns (user_factors = U * S, item_factors = V, singular values); factors stay partitioned tables.
    """
    n_users, n_items = (resid.select(c).distinct().count() for c in ("user_id", "business_id"))
    rank = effective_rank(n_components, n_users, n_items)
    users, items, singular, _ = truncated_svd(resid, "user_id", "business_id", "residual", rank, seed, max_steps=n_iter, oversample=oversample)
    return users, items, singular


def fit(spark, interactions: DataFrame, n_components: int = K.N_COMPONENTS, n_iter: int = MAX_STEPS,
        seed: int = K.SEED) -> CFModel:
    """A8 -> A9 -> A10 -> C2, plus the seen pairs."""
    r = ratings(interactions).persist(StorageLevel.MEMORY_AND_DISK)
    mu, ub, ib = fit_biases(r)
    resid = residuals(r, mu, ub, ib)
    uf, itf, _ = fit_svd(spark, resid, n_components, n_iter, seed=seed)
    return CFModel(mu, ub, ib, uf, itf, r.select("user_id", "business_id"))
