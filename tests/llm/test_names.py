"""Extra columns of any name come through every operator that carries columns unharmed."""

import random

import pytest
from pyspark.sql import functions as F

from tastegrid.llm import html_extract, line_dedup, near_dup, quality, revisits, substring_dedup, url_filter

from .helpers import docs, prose

NAMES = ("_t", "_w", "_l", "_h", "_p", "_e", "_i", "_row", "_doc", "_own", "_of", "_in", "_found", "_version", "_text", "_wanted", "_id", "_no_id",
         "_html", "_host", "starts", "_keys", "_hits", "_at", "_blocked", "_h1", "_h2", "_u", "_is", "_block", "_r", "_near", "_carried", "_f", "_end",
         "in_0", "in_1", "in_7", "doc", "version", "shard", "tokens", "place", "edge", "digest", "a b", "x`y")
ADDED = {"line": ("n_lines", "n_dropped", "drops"), "substring": ("kept", "n_bytes", "n_removed", "spans"), "url": ("rule", "verdict"), "html": ("text", "n_chars"),
         "quality": ("n_words", "kept"), "judge": ("posterior", "vote_symbols"), "near": (), "revisit": ("outcome", "merged")}


def table(spark, kind):
    rnd = random.Random(1)
    if kind in ("url", "html"):
        rows = [(i, f"http://h{i % 3}.net/en/{i}", f"<html><body><div><p>{prose(rnd, 30)}</p></div></body></html>") for i in range(9)]
        return spark.createDataFrame(rows, "key bigint, url string, html string")
    if kind == "revisit":
        rows = [(i, "http://a.b/c", "response" if i < 3 else "revisit", i, {"ETag": "x"}) for i in range(6)]
        return spark.createDataFrame(rows, "record_id bigint, url string, kind string, time bigint, headers map<string,string>").withColumn("key", F.col("record_id"))
    same = prose(rnd, 90)
    return docs(spark, [(i, prose(rnd, 20) + "\n" + (same if i % 2 else prose(rnd, 20)) + "\nlast line of all") for i in range(8)]).withColumn("key", F.col("doc_id"))


OPS = {"line": line_dedup.dedup_lines, "substring": substring_dedup.remove_repeats, "near": near_dup.drop_near_duplicates, "quality": quality.measures,
       "judge": quality.judge, "url": url_filter.filter_urls, "html": html_extract.extract, "revisit": revisits.resolve}


@pytest.mark.parametrize("kind", list(OPS))
def test_names_do_not_clash(spark, kind):
    plain = table(spark, kind)
    extra = {n: F.concat(F.lit(n + "-"), F.col("key").cast("string")) for n in (*NAMES, *ADDED[kind]) if n not in plain.columns}
    got = OPS[kind](plain.withColumns(extra))
    want = OPS[kind](plain)
    kept = [n for n in extra if n not in want.columns]
    q = lambda n: F.col("`" + n.replace("`", "``") + "`")
    assert set(got.columns) == set(want.columns) | set(kept) and len(got.columns) == len(set(got.columns))
    assert got.where(" OR ".join("NOT(`" + n.replace("`", "``") + f"` <=> concat('{n}-', key))" for n in kept)).count() == 0
    same = [c for c in want.columns if not want.schema[c].dataType.simpleString().startswith("map")]
    rows = lambda df: sorted(str(r) for r in df.select(*map(q, same)).collect())
    assert rows(got) == rows(want)
