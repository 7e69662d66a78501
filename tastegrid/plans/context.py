"""Per-job context: the shared DataFrames of one run, built lazily once.

Re-using one DataFrame object for a sub-plan lets Spark reuse its exchanges
(``ReusedExchange``) inside a job instead of planning it twice.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid import constants as K
from tastegrid.operators import prepare
from tastegrid.session import cut_lineage
from tastegrid.sources import catalog


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    # -- raw reference-shaped tables ---------------------------------------
    @cached_property
    def review(self) -> DataFrame:
        return catalog.reviews(self.spark, self.sf_dir)

    @cached_property
    def business(self) -> DataFrame:
        return catalog.businesses(self.spark, self.sf_dir, self.review)

    @cached_property
    def catalogue(self) -> DataFrame:
        """Model catalogue: businesses with enough reviews, any category."""
        return (prepare.filter_businesses(self.business, K.MIN_BUSINESS_REVIEWS, category_keyword=None)
                .persist(StorageLevel.MEMORY_AND_DISK))

    @cached_property
    def review_sel(self) -> DataFrame:
        return prepare.select_reviews(self.review, self.catalogue)

    @cached_property
    def interactions(self) -> DataFrame:
        # Read by many branches of one job: computed once, kept in memory and
        # disk (recomputed from lineage if an executor is lost).
        return prepare.build_interactions(self.review_sel).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def tip_count(self) -> DataFrame:
        return prepare.tip_counts(catalog.tips(self.spark, self.sf_dir), self.catalogue)

    @cached_property
    def checkin_count(self) -> DataFrame:
        return prepare.checkin_counts(catalog.checkins(self.spark, self.sf_dir), self.catalogue)

    @cached_property
    def biz_prior(self) -> DataFrame:
        """Catalogue with tip / check-in counts and the popularity prior (the business index)."""
        return (prepare.add_business_priors(self.catalogue, self.tip_count, self.checkin_count)
                .persist(StorageLevel.MEMORY_AND_DISK))

    @cached_property
    def priors(self) -> DataFrame:
        return self.biz_prior.select("business_id", "popularity_prior")

    @cached_property
    def user_counts(self) -> DataFrame:
        return self.interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_hist"))

    @cached_property
    def local_log(self) -> DataFrame:
        return catalog.local_interactions(self.spark, self.sf_dir)

    @cached_property
    def request_events(self) -> DataFrame:
        return catalog.request_events(self.spark, self.sf_dir)


def written_reviews(c: Ctx) -> Ctx:
    """The context with its reviews joined and written once: statistics, catalogue and raw files all start from them."""
    c.review = cut_lineage(c.review, "reviews")
    return c
