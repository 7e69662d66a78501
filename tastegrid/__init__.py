"""tastegrid: a Spark-native hybrid recommendation analytics engine.

Data preparation, a TF-IDF content model, a bias + low-rank collaborative
model, an adaptive blend of both, ranking evaluation and activity reporting,
all written as DataFrame / SQL jobs.
"""

__version__ = "0.1.0"
