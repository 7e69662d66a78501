"""Imports every operator module, whose queries and SQL then stand in ``QUERIES`` and ``ORACLE``."""

from tastegrid.llm import bpe, decontaminate, hard_negatives, html_extract, line_dedup, merkle, near_dup, quality, revisits, substring_dedup, token_counts, toxicity, url_filter  # noqa: F401
from tastegrid.llm.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
