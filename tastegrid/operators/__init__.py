"""DataFrame -> DataFrame operators of the recommender."""
