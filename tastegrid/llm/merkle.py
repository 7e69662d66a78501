"""Merkle manifest of a dataset, with a proof for every record.

Records are leaves of a tree for each group, in order of their ids; a node covers an interval of leaf ranks
``[lo, hi)`` and that interval is its label: an ancestor at a level is the node whose interval contains the leaf's, and
the siblings at a level are what the parent's interval holds outside the node's own.  With ``FAN`` children a node,
level k's intervals begin at multiples of FAN ** k, so ``lo div FAN ** k`` buckets a level and containment is an
equi-join on the bucket with a check of the intervals.

Ranks come from range partitions and prefix sums (no task sorts a whole group).  The tree is built upwards by one
aggregate a level, each a sixteenth of the one before.  Proofs go downwards: a node takes over its parent's steps and adds
its own siblings, so joined rows shrink by ``FAN`` a level as well; only the last step meets the leaves.  A proof
step is the pair of texts left and right of the node in its run.  Texts are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tastegrid.llm.common import documents, query
from tastegrid.operators.positions import with_positions, written

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tampering of the query meets the ids whose checksum this divides.
TAMPER = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEPS = "array<struct<left:string,right:string>>"


def record_digest(values: Sequence[Column]) -> Column:
    """sha256 (hex) of the values one after the other: ``-`` for null, else byte count, ``:`` and the value."""
    def part(v: Column) -> Column:
        v = v.cast("string")
        return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
    return F.sha2(F.concat(*(part(v) for v in values)), 256)


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def _level_up(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes of ``level`` + 1 from those of ``level``, for the trees of more than one node there.

    nodes: (tree, size, lo, hi, digest); the result also has children, the node's (lo, hi, digest) in order.
    """
    span = FAN ** level
    above = nodes.where(F.col("size") > span).withColumn("bucket", F.expr(f"lo div {span * FAN}L"))
    run = above.groupBy("tree", "size", "bucket").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
    return run.select("tree", "size", F.element_at("children", 1)["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"),
                      _joined(F.col("children")["digest"]).alias("digest"), "children")


def build_levels(leaves: DataFrame, largest: int) -> list[DataFrame]:
    """[level 1, level 2, ...] above ``leaves`` (tree, size, lo, hi, digest); ``largest`` is the greatest size."""
    out, nodes, level = [], leaves, 0
    while FAN ** level < largest:
        nodes = written(_level_up(nodes, level), "merkle")
        out.append(nodes)
        nodes = nodes.drop("children")
        level += 1
    return out


def roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, root): the nodes that cover their whole tree; a lone leaf is its own root."""
    out = leaves.where("size = 1").select("tree", F.col("digest").alias("root"))
    for nodes in levels:
        out = out.union(nodes.where("lo = 0 AND hi = size").select("tree", F.col("digest").alias("root")))
    return out


def _outside(children: Column, lo: Column, hi: Column) -> Column:
    """The parent's interval less ``[lo, hi)``: the step (left, right) that the siblings make."""
    return F.struct(F.array_join(F.filter(children, lambda c: c["hi"] <= lo)["digest"], "").alias("left"),
                    F.array_join(F.filter(children, lambda c: c["lo"] >= hi)["digest"], "").alias("right"))


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    """``nodes`` (with children, steps, subroot) as the parents of level ``level``, keyed by bucket."""
    return nodes.select(F.col("tree").alias("p_tree"), F.expr(f"lo div {FAN ** (level + 1)}L").alias("p_bucket"),
                        *(F.col(c).alias(f"p_{c}") for c in ("lo", "hi", "children", "steps", "subroot")))


def _below(nodes: DataFrame, parents: DataFrame, level: int) -> DataFrame:
    """``nodes`` of ``level`` with the parent whose interval contains theirs, and the steps that follow from it."""
    within = nodes.withColumn("bucket", F.expr(f"lo div {FAN ** (level + 1)}L")).join(
        _parents(parents, level), F.col("tree").eqNullSafe(F.col("p_tree")) & (F.col("bucket") == F.col("p_bucket"))
        & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))
    own = F.array(_outside(F.col("p_children"), F.col("lo"), F.col("hi")))
    return within.select(*nodes.columns, F.concat(own, F.col("p_steps")).alias("steps"), F.col("p_subroot").alias("subroot"))


def attach_steps(leaves: DataFrame, levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """``leaves`` (tree, size, lo, hi, ...) with ``steps``, the siblings from their own to beyond the root, and ``subroot``.

    ``top`` (tree, steps, subroot) holds the steps that follow each tree's root.
    """
    top = top.select(F.col("tree").alias("p_tree"), "steps", "subroot")
    is_root = (F.col("lo") == 0) & (F.col("hi") == F.col("size"))
    down = None
    for level in range(len(levels), -1, -1):
        nodes = levels[level - 1] if level else leaves
        # one row a tree meets its own row of ``top``; all others take the steps of the level above
        done = nodes.where(is_root).join(top, F.col("tree").eqNullSafe(F.col("p_tree"))).select(*nodes.columns, "steps", "subroot")
        if down is not None:
            done = done.union(_below(nodes.where(~is_root), down, level))
        down = done
    return down


def manifest(df: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", group: str = "source",
             tampered: dict[str, Column] | None = None) -> DataFrame:
    """Rows (doc_id, group, rank, leaf, subroot, root, steps, folded_root, verified), one for each row of ``df``.

    A leaf is the digest of ``fields``; leaves of a group stand in order of id, equal ids in order of their digests, null
    ids first.  Sixteen neighbours, the last run fewer, make a node, up to the group's subroot; subroots in order
    of group (null first, else by bytes) make the root in the same way.  steps are the siblings left and right at each level
    from the leaf to the root (both empty where a run has one node only).  ``tampered`` maps fields to what stands in their place when
    the record is checked: folded_root is computed from that record and the steps, verified says that it is the root.

    Repeated rows are leaves of their own; null fields count as ``-``; empty texts as ``0:``.  Columns beyond ``fields``, ``doc_id``
    and ``group`` are not read, whatever their names.  A table of one row has its leaf as root.  An empty table gives an empty
    table.
    """
    own = record_digest([F.col(f) for f in fields])
    # null: the record is as it was
    other = F.nullif(record_digest([(tampered or {}).get(f, F.col(f)) for f in fields]), own) if tampered else F.lit(None).cast("string")
    records = df.select(F.col(group).alias("tree"), F.col(doc_id).alias("id"), own.alias("leaf"), other.alias("checked"))
    # the texts' digests are computed once; ranks within a group begin at 0
    ranked = with_positions(written(records, "merkle"), ["tree"], [F.col("id").asc_nulls_first(), F.col("leaf")], "rank", "size")
    ranked = written(ranked.select("tree", "size", (F.col("rank") - 1).alias("lo"), F.col("rank").alias("hi"), "id", "leaf", "checked"), "merkle")
    leaves = ranked.select("tree", "size", "lo", "hi", F.col("leaf").alias("digest"))
    levels = build_levels(leaves, leaves.agg(F.max("size")).head()[0] or 0)

    # the groups' own tree: one leaf for each group
    groups = with_positions(written(roots(leaves, levels), "merkle"), [], [F.col("tree").asc_nulls_first()], "rank", "size")
    groups = written(groups.select(F.lit(0).alias("tree"), "size", (F.col("rank") - 1).alias("lo"), F.col("rank").alias("hi"),
                                   F.col("root").alias("digest"), F.col("tree").alias("group")), "merkle")
    above = build_levels(groups.drop("group"), groups.count())
    root = roots(groups, above).head()  # one row
    nothing = groups.select("tree").limit(1).select("tree", F.array().cast(_STEPS).alias("steps"), F.lit(None).cast("string").alias("subroot"))
    top = attach_steps(groups, above, nothing).select(F.col("group").alias("tree"), "steps", F.col("digest").alias("subroot"))
    proven = attach_steps(ranked, levels, written(top, "merkle"))
    folded = F.aggregate("steps", F.coalesce("checked", "leaf"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    out = proven.select(F.col("id").alias(doc_id), F.col("tree").alias(group), F.col("lo").alias("rank"), "leaf", "subroot",
                        F.lit(root and root["root"]).cast("string").alias("root"), "steps", folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof(steps: Column) -> Column:
    """The siblings of all levels, left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""


def _sql_digest(text: str) -> str:
    part = lambda v: f"coalesce(strlen(({v})::VARCHAR)::VARCHAR || ':' || ({v})::VARCHAR, '-')"
    return "sha256(" + " || ".join(part(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _sql_tree(name: str, leaves: str) -> str:
    """Nodes of the trees over ``leaves`` (tree, idx, digest), and each node's siblings left and right."""
    return f"""{name}_n AS (
  SELECT tree, 0 AS level, idx, digest, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, idx // {FAN}, sha256(string_agg(digest, '' ORDER BY idx)), (max(n) + {FAN - 1}) // {FAN}
  FROM {name}_n WHERE n > 1 GROUP BY tree, level, idx // {FAN}),
{name}_s AS (
  SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {name}_n a JOIN {name}_n b ON b.tree IS NOT DISTINCT FROM a.tree AND b.level = a.level AND b.idx // {FAN} = a.idx // {FAN}
  WHERE a.n > 1 GROUP BY a.tree, a.level, a.idx),
{name}_r AS (SELECT tree, digest FROM {name}_n WHERE n = 1)"""


_SQL = f"""
WITH RECURSIVE recs AS (
  SELECT doc_id, source, {_sql_digest('text')} AS leaf,
         CASE WHEN {_CRC} % {TAMPER} = 0 THEN {_sql_digest(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_sql_digest('text')} END AS checked
  FROM documents),
leaves AS (SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS digest,
                  doc_id, checked FROM recs),
{_sql_tree("one", "leaves")},
tops AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx, digest, tree AS source FROM one_r),
{_sql_tree("all", "tops")},
fold AS (
  SELECT tree, idx AS leaf_idx, 0 AS level, idx, checked AS h, '' AS p FROM leaves
  UNION ALL
  SELECT f.tree, leaf_idx, f.level + 1, f.idx // {FAN}, sha256(l || h || r), p || l || r
  FROM fold f JOIN one_s s ON s.tree IS NOT DISTINCT FROM f.tree AND s.level = f.level AND s.idx = f.idx),
sub AS (SELECT DISTINCT ON (tree, leaf_idx) tree, leaf_idx, h, p FROM fold ORDER BY tree, leaf_idx, level DESC),
fold_all AS (
  SELECT b.tree, b.leaf_idx, 0 AS level, t.idx, b.h, b.p FROM sub b JOIN tops t ON t.source IS NOT DISTINCT FROM b.tree
  UNION ALL
  SELECT f.tree, leaf_idx, f.level + 1, f.idx // {FAN}, sha256(l || h || r), p || l || r
  FROM fold_all f JOIN all_s s ON s.level = f.level AND s.idx = f.idx),
done AS (SELECT DISTINCT ON (tree, leaf_idx) tree, leaf_idx, h, p FROM fold_all ORDER BY tree, leaf_idx, level DESC)
SELECT doc_id, v.digest AS leaf, o.digest AS subroot, a.digest AS root, sha256(p) AS proof_sha256, h AS folded_root, h = a.digest AS verified
FROM leaves v JOIN done d ON d.tree IS NOT DISTINCT FROM v.tree AND d.leaf_idx = v.idx
JOIN one_r o ON o.tree IS NOT DISTINCT FROM v.tree CROSS JOIN all_r a"""


@query("op12_merkle_manifest", _SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots, digest of its proof, and whether the (in part tampered) record still verifies."""
    picked = F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0
    text = F.when(picked, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    out = manifest(documents(spark, sf_dir), tampered={"text": text})
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("steps")), 256).alias("proof_sha256"), "folded_root", "verified")
