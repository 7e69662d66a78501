"""Hard negatives by Kronecker-packed integer products.

Vectors become integers.  To score candidates against an anchor, the components of several candidates are shifted to be
non-negative and put side by side into bit fields of one wide integer, component by component; the sum of (shifted anchor
component) x (wide integer) over the components then holds every candidate's shifted inner product in its own field, as
the fields are wide enough for the largest possible sum.  Taking the fields apart and taking the shifts off gives the
exact scores.  A double carries integers of 53 bits exactly, so the sums of all anchors of a block are one matrix
product; a block whose fields do not fit takes Python integers, through the same code.

Anchors and candidates are dealt into blocks and meet as a grid of (anchor block, candidate block): a block's task emits
the best few of its candidates for each anchor, and a window keeps the best over the blocks.  Candidates go by a hash of
id and place, so that no repeated id or vector fills a block.  A first pass finds each anchor's positives (only rows of its
label are multiplied), a second one the negatives within the limits that the positives' scores set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tastegrid.llm.common import query
from tastegrid.operators.positions import written
from tastegrid.sources.tables import read_table

POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between this share of the positive's and the positive's.
LOW, HIGH = 80, 100
SCALE = 256
#: Rows of a candidate block, anchors of an anchor block, least number of candidate blocks.
BLOCK_ROWS, BLOCK_ANCHORS, MIN_BLOCKS = 65_536, 8_192, 24
#: Scores held at once in a task.
CELLS = 1 << 21
_MANTISSA, _WIDE_FIELDS = 53, 4
_LONG = 2**63 - 1


def vectors(column: pa.ChunkedArray | pa.Array, scale: int = SCALE) -> np.ndarray:
    """Rows of floor(scale * component); rows shorter than the longest are filled with 0."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(col.offsets.to_numpy())
    flat = np.floor(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    width = int(sizes.max(initial=0))
    if len(flat) and np.abs(flat).max() >= 2**31:
        flat = np.array([int(v) for v in flat], object)
    else:
        flat = flat.astype(np.int64)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def packed(candidates: np.ndarray, bias: int, bits: int, fields: int) -> np.ndarray:
    """(components, groups): wide integers of ``fields`` candidates each, ``bits`` apart."""
    n, width = candidates.shape
    groups = -(-n // fields)
    out = np.zeros((width, groups), candidates.dtype)
    for i in range(fields):
        part = (candidates[i::fields] + bias).T
        out[:, :part.shape[1]] += part << (bits * i)
    return out


def products(anchors: np.ndarray, candidates: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Exact inner products in 64-bit integers (beyond that range the nearest one), for some anchors at a time.

    Yields (anchors, scores): a slice of the anchors and their scores with all candidates.
    """
    width = max(anchors.shape[1], candidates.shape[1])
    anchors, candidates = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (anchors, candidates))
    n = len(candidates)
    if not n or not len(anchors):
        return
    a_bias, c_bias = (int(-x.min(initial=0)) for x in (anchors, candidates))
    most = width * (int(anchors.max(initial=0)) + a_bias) * (int(candidates.max(initial=0)) + c_bias)
    bits = max(1, most.bit_length())
    wide = bits > _MANTISSA
    fields = _WIDE_FIELDS if wide else _MANTISSA // bits
    kind = object if wide else np.int64
    anchors, candidates = anchors.astype(kind), candidates.astype(kind)
    both, shifted = packed(candidates, c_bias, bits, fields), anchors + a_bias
    if not wide:  # whole numbers that a double holds exactly, sums included
        both, shifted = both.astype(np.float64), shifted.astype(np.float64)
    off_anchor = c_bias * anchors.sum(axis=1) + width * a_bias * c_bias
    off_candidate = a_bias * candidates.sum(axis=1)
    mask, step = (1 << bits) - 1, max(1, CELLS // n)
    for a in range(0, len(anchors), step):
        part = slice(a, a + step)
        sums = shifted[part].dot(both)
        if not wide:
            sums = sums.astype(np.int64)
        scores = np.empty((len(sums), n), kind)
        for i in range(fields):
            scores[:, i::fields] = ((sums >> (bits * i)) & mask)[:, :-(-(n - i) // fields)]
        scores -= off_anchor[part][:, None]
        scores -= off_candidate[None, :]
        yield part, np.clip(scores, -_LONG, _LONG).astype(np.int64) if wide else scores


def _first(row: np.ndarray, count: int) -> np.ndarray:
    """Which entries are among the first ``count`` of their row (rows are consecutive)."""
    new = np.flatnonzero(np.diff(row, prepend=-1))
    return np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row)))) < count


def _best(scores: np.ndarray, allowed: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``count`` best allowed entries, equal scores by column."""
    low = np.where(allowed, scores, -_LONG - 1)
    if low.shape[1] > count:
        least = np.partition(low, -count, axis=1)[:, -count]
        allowed = allowed & (low >= least[:, None])
    row, col = np.nonzero(allowed)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    keep = _first(row, count)
    return row[keep], col[keep]


def _positives(count: int, scale: int):
    """Task: (anchor_id, positive_id, score) of the best of a candidate block that have the anchor's label."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a_id, a_label, a = left["id"].to_numpy(), left["label"].to_numpy(), vectors(left["vector"], scale)
        order = np.argsort(right["id"].to_numpy(), kind="stable")
        c_id, c_label, c = right["id"].to_numpy()[order], right["label"].to_numpy()[order], vectors(right["vector"], scale)[order]
        out = [np.empty((3, 0), np.int64)]
        for label in np.unique(a_label):
            mine, of = np.flatnonzero(a_label == label), np.flatnonzero(c_label == label)
            for part, s in products(a[mine], c[of]):
                some = mine[part]
                row, col = _best(s, a_id[some][:, None] != c_id[of][None, :], count)
                out.append(np.stack([a_id[some][row], c_id[of][col], s[row, col]]))
        found = np.concatenate(out, axis=1)
        return pa.table({"anchor_id": found[0], "positive_id": found[1], "positive_score": found[2]})
    return run


def _negatives(count: int, slots: int, scale: int, low: int, high: int):
    """Task: (anchor_id, slot, negative_id, negative_score) of the best of a candidate block within each positive's limits."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a_id, a_label, a = left["id"].to_numpy(), left["label"].to_numpy(), vectors(left["vector"], scale)
        order = np.argsort(right["id"].to_numpy(), kind="stable")
        c_id, c_label, c = right["id"].to_numpy()[order], right["label"].to_numpy()[order], vectors(right["vector"], scale)[order]
        # least and greatest score of a negative for each positive; none where there are fewer positives
        lo, hi = np.ones((len(a_id), slots), np.int64), np.zeros((len(a_id), slots), np.int64)
        for i, scores in enumerate(left["scores"].to_pylist()):
            for j, p in enumerate(scores):
                lo[i, j], hi[i, j] = -(-low * p // 100), high * p // 100
        out = [np.empty((4, 0), np.int64)]
        for part, s in products(a, c):
            wanted = hi[part] >= lo[part]
            least = np.where(wanted, lo[part], _LONG).min(axis=1)
            most = np.where(wanted, hi[part], -_LONG).max(axis=1)
            row, col = np.nonzero((s >= least[:, None]) & (s <= most[:, None]) & (a_label[part][:, None] != c_label[None, :]))
            score = s[row, col]
            order = np.lexsort((col, -score, row))
            row, col, score = row[order], col[order], score[order]
            for j in range(slots):
                at = np.flatnonzero((score >= lo[part][row, j]) & (score <= hi[part][row, j]))
                at = at[_first(row[at], count)]
                out.append(np.stack([a_id[part][row[at]], np.full(len(at), j), c_id[col[at]], score[at]]))
        found = np.concatenate(out, axis=1)
        return pa.table({"anchor_id": found[0], "slot": found[1], "negative_id": found[2], "negative_score": found[3]})
    return run


def usable(df: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """(id, label, vector) of the rows that take part."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(finite)


def mine(df: DataFrame, anchors: Column, label: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all long but rank (int).

    ``anchors`` is a condition on ``df``'s columns that picks the anchors.  A row's score is the inner product of the integers
    floor(scale * component) with the anchor's; higher scores come first, equal ones by smaller id.  An anchor's positives are its first
    ``positives`` rows of the same label and another id; for each, its negatives are the first ``negatives`` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score, ranked from 1.

    Rows with a null id, label or vector or a null or non-finite component take no part.  Rows that share an id are rows of their
    own, as candidates; as anchor only the least of them by label, then vector, counts.  Vectors may differ in length: missing
    components are 0, so an empty vector scores 0 with all.  Scores beyond 64 bits count as the nearest 64-bit integer.  Anchors
    without positives or negatives give no rows, nor does an empty table.  Columns that are not named are not read.
    """
    label = F.col("label") if label is None else label
    rows = usable(df, vec_id, vector, label)
    picked = usable(df.where(anchors), vec_id, vector, label)
    # one row for each anchor id; repeats are combined before the shuffle
    picked = written(picked.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector"), "anchors")
    n_anchors, n_rows = picked.count(), rows.count()
    a_blocks, c_blocks = max(1, -(-n_anchors // BLOCK_ANCHORS)), max(MIN_BLOCKS, -(-n_rows // BLOCK_ROWS))
    a_block = F.pmod(F.xxhash64("id"), F.lit(a_blocks)).cast("int")
    c_block = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(c_blocks)).cast("int")
    dealt = (rows.withColumn("c", c_block).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(a_blocks - 1))))
             .select("a", "c", "id", "label", "vector"))

    def grid(left: DataFrame, task, schema: str) -> DataFrame:
        left = left.withColumn("a", a_block).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
        return left.groupBy("a", "c").cogroup(dealt.groupBy("a", "c")).applyInArrow(task, schema)

    found = grid(picked, _positives(positives, scale), "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    kept = found.withColumn("slot", F.row_number().over(first) - 1).where(F.col("slot") < positives)
    by_anchor = kept.groupBy(F.col("anchor_id").alias("of")).agg(
        F.sort_array(F.collect_list(F.struct("slot", "positive_id", "positive_score"))).alias("positives"))  # ``positives`` at most
    asked = written(picked.join(by_anchor, F.col("id") == F.col("of")).drop("of").withColumn("scores", F.col("positives")["positive_score"]), "anchors")
    hits = grid(asked.drop("positives"), _negatives(negatives, positives, scale, low, high),
                "anchor_id long, slot long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), "negative_id")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = asked.select(F.col("id").alias("of"), F.explode("positives").alias("p")).select("of", "p.*")
    out = hits.join(named, (F.col("anchor_id") == F.col("of")) & (hits["slot"] == named["slot"]))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
         list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * c.q[i]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= {NEGATIVES}"""


@query("op13_hard_negatives", _SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector and each of its positives the hardest rows of other labels."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
