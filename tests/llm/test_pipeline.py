import os
import random

import pytest

import corpus_pipeline
from tastegrid.llm import decontaminate as dc, quality

from . import test_line_dedup, test_near_dup
from .helpers import DOCS, docs, prose

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_stages_equal_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, table, SF).cache()
    judged = {r["doc_id"]: r["kept"] for r in quality.op4_quality_rules(spark, SF).collect()}
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {d for d, k in judged.items() if k}
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    lines = stages["line_dedup"](spark, kept, SF).cache()
    assert lines.columns == table.columns
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {r[0]: r[3] for r in test_line_dedup.brute(rows)}
    rows = [(r["doc_id"], r["text"]) for r in lines.collect()]
    near = stages["near_dedup"](spark, lines, SF).cache()
    assert near.columns == table.columns
    assert {r["doc_id"] for r in near.collect()} == {r[0] for r in test_near_dup.brute(rows, 5, 80) if r[3]}
    clean = stages["decontamination"](spark, near, SF)
    items = [" ".join(dc.normal_words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hold = {r["doc_id"] for r in near.collect() if any(i in " ".join(dc.normal_words(r["text"])) for i in items)}
    assert clean.columns == table.columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in near.collect()} - hold
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in clean.collect()}


def test_stages_take_odd_tables(spark):
    rnd = random.Random(1)
    good = "\n".join(prose(rnd, 12).capitalize() + "." for _ in range(6))
    rows = [(1, None), (2, ""), (3, good), (None, good), (4, good), (4, good), (5, "x " * 50_000)]
    for table in (docs(spark, []), docs(spark, rows), spark.createDataFrame([(3, good, None, None, None)], DOCS)):
        at = table
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, SF).cache()
            assert at.count() <= table.count()
