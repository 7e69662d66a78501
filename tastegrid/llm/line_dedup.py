"""Line deduplication with keep bitmaps (DataFrame functions only).

Lines become 128-bit hashes of their keys with document and position; no text is moved.  The hashes
are range-partitioned and sorted by document and position within; one pass over each key's rows
streams its first document, and every other document's lines of that key are marked.  The result
is a sparse bitmap per document; the text meets it only when the bitmaps are applied.

A key that a large share of all documents holds must not fill one range.  A heavy-hitter sketch
over all lines names such keys (at most ``HEAVY_KEYS``); their rows are cut into blocks by
document, each block is streamed by itself, and the least first document over the blocks, one row
for each heavy key, settles the rest.  The sketch only decides how rows are dealt out, not what
comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tastegrid.llm.common import documents, query, saved, shielded, text_or_empty

MIN_KEY_CHARS = 10
#: Keys that may be heavy, items of the sketch, blocks of a heavy key; heavy is a key with at least one
#: in ``HEAVY_SHARE`` of all lines.
HEAVY_KEYS, SKETCH_ITEMS, BLOCKS, HEAVY_SHARE = 1_000, 20_000, 1_024, 2_000
_WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(_WHITE))
    # without characters beyond ASCII the plain lower() does the same
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(df: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """Rows (h1, h2, doc, version, pos) of the lines with a key long enough to count."""
    t = text_or_empty(text)
    rows = df.select(F.col(doc_id).alias("doc"), F.xxhash64(t).alias("version"),
                     F.posexplode(F.split(t, "\n")).alias("pos", "line"))
    rows = rows.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "version", "pos")


def drop_bitmaps(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """Rows (doc, version, drops) of the documents that lose lines.

    drops is a sparse bitmap: an array of (word, bits), bit b of a word standing for line 64 * word + b.
    version is a hash of the text, so that different texts under one id keep their own bitmaps.
    """
    # read by the sketch, by the sample of the ranges and by the ranges: texts are cut into lines once
    rows = saved(_lines(df, doc_id, text, min_chars))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h1, {HEAVY_KEYS}, {SKETCH_ITEMS})").alias("top"))
    # at most HEAVY_KEYS numbers, without bearing on the result
    heavy = [r["h1"] for r in seen.select("n", F.explode("top").alias("x"))
             .where(F.col("x.count") * HEAVY_SHARE >= F.col("n")).select(F.col("x.item").alias("h1")).collect()]
    block = F.pmod(F.xxhash64("doc"), F.lit(BLOCKS)).cast("int")
    is_heavy = F.col("h1").isin(heavy) if heavy else F.lit(False)
    ranged = (rows.withColumn("block", F.when(is_heavy, block).otherwise(F.lit(-1)))
              .repartitionByRange("h1", "h2", "block"))
    in_order = Window.partitionBy("h1", "h2", "block").orderBy(F.col("doc").asc_nulls_last(), "pos")
    streamed = ranged.withColumn("first_doc", F.first("doc").over(in_order))
    marked = streamed.where((F.col("block") >= 0) | ~F.col("doc").eqNullSafe(F.col("first_doc")))
    if heavy:
        marked = saved(marked)
        least = (marked.where(F.col("block") >= 0).groupBy("h1", "h2").agg(F.min("first_doc").alias("least_doc"))
                 .withColumn("settles", F.lit(True)))
        marked = (marked.join(F.broadcast(least), ["h1", "h2"], "left")  # a row for each heavy key
                  .where(F.col("settles").isNull() | ~F.col("doc").eqNullSafe(F.col("least_doc"))))
    words = (marked.groupBy("doc", "version", F.shiftright("pos", 6).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits")))
    sparse = words.groupBy("doc", "version").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("s"))
    none = F.array().cast("array<bigint>")
    dense = F.aggregate("s", none, lambda acc, x: F.concat(
        acc, F.array_repeat(F.lit(0).cast("bigint"), x["word"] - F.size(acc)), F.array(x["bits"])))
    return sparse.select("doc", "version", dense.alias("drops"))


@shielded("doc_id", "text")
def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """``df`` with its repeated lines gone from ``text``, and columns n_lines, n_dropped, drops.

    A line whose key has at least ``min_chars`` code points and is found in at least two documents
    stays only in the document with the least id, there as often as it occurs.  Rows that share an
    id are one document; a null id is one document after all others.  Null and empty texts are one
    empty line, which stays; the text becomes empty, not null.  Every row stays, and other columns
    are carried; columns of the added names are replaced, no other name clashes.  An empty table gives an empty table.
    """
    df = df.drop("n_lines", "n_dropped", "drops")
    bitmaps = drop_bitmaps(df, doc_id, text, min_chars).select(
        F.col("doc").alias("_doc"), F.col("version").alias("_version"), F.col("drops").alias("drops"))
    docs = df.withColumn(text, text_or_empty(text)).withColumn("_own", F.xxhash64(text))
    joined = docs.join(bitmaps,
                       docs[doc_id].eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_version")), "left")
    lines = F.split(text, "\n")
    bit = lambda i: F.getbit(
        F.coalesce(F.get("drops", F.shiftright(i, 6)), F.lit(0).cast("bigint")), i.bitwiseAND(F.lit(63)))
    kept = F.array_join(F.filter(lines, lambda x, i: bit(i) == 0), "\n")
    dropped = F.aggregate("drops", F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w))
    return (joined.withColumns({"n_lines": F.size(lines).cast("bigint"),
                                "n_dropped": F.coalesce(dropped, F.lit(0).cast("bigint"))})
            .withColumn(text, F.when(F.col("drops").isNull(), F.col(text)).otherwise(kept))
            .select(*df.columns, "n_lines", "n_dropped", "drops"))


_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= {MIN_KEY_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.first_doc AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


@query("op6_line_dedup", _SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of lines, of dropped lines, and the digest of what is left."""
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
