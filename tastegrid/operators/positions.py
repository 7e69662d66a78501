"""Row numbers within groups of any size.

``row_number() over (partition by key)`` sorts each key's rows in one task.  Here rows are dealt out by ranges
of (key, order), so a key that owns a large share of all rows is cut into several ranges; a row's number is its place
within the range plus the counts of the key's earlier ranges.  The ranges' counts are one row for each key and
partition that holds it: as many as keys plus partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tastegrid.session import cut_lineage

#: ``monotonically_increasing_id`` counts rows in the low 33 bits and partitions above them.
_PARTITION_SHIFT = 33
#: Rows of a key from which on one task does not number it; keys that may have so many, items of the sketch that names them.
HEAVY_ROWS, HEAVY_KEYS, SKETCH_ITEMS = 200_000, 1_000, 20_000


def written(df: DataFrame, label: str = "rows") -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back."""
    return cut_lineage(df, label)


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], position: str = "position",
                   total: str | None = None) -> DataFrame:
    """``df`` with ``position``, the 1-based row number within ``keys`` by ``order``; ``total`` adds the key's rows.

    Null keys are one group; rows that ``order`` does not tell apart get consecutive numbers in any order.  Columns of
    the added names are replaced; all other columns and all rows are kept, whatever their names.  No task gets more of
    a key than of any other range.
    """
    kept = [c for c in df.columns if c not in (position, total)]
    names = [f"k{i}" for i in range(len(keys))]
    key_cols = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    by = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    # the numbering must be read twice alike, so it is written
    dealt = written(dealt.select(*key_cols, F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"),
                                 F.monotonically_increasing_id().alias("at")), "positions")
    part = F.shiftright("at", _PARTITION_SHIFT)
    pieces = dealt.groupBy(*names, part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*(F.col(n).alias(f"p_{n}") for n in names), F.col("part").alias("p_part"),
                           (F.coalesce(F.sum("n").over(so_far), F.lit(0)) - F.col("first") + 1).alias("shift"),
                           F.sum("n").over(Window.partitionBy(*names)).alias("of"))
    on = part == F.col("p_part")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"p_{n}"))
    out = dealt.join(pieces, on).select(
        *(F.col("row").getField(c).alias(c) for c in kept), (F.col("at") + F.col("shift")).alias(position),
        *([F.col("of").alias(total)] if total else []))
    return out


def with_positions_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], position: str = "position",
                          total: str | None = None, previous: tuple[str, str] | None = None) -> DataFrame:
    """``with_positions`` for keys of which few, or none, have very many rows.

    Rows are clustered by key and numbered by a window, without an exchange where ``df`` is clustered so already; the result
    stays clustered.  Keys that a sketch names as heavy (``HEAVY_ROWS``) are numbered by ranges; the sketch only decides how rows are
    dealt out.  Of rows that ``order`` does not tell apart the other columns decide, so that reading twice numbers
    alike.  ``df`` is read once more for the sketch, and once more for heavy keys if there are any.
    ``previous`` (column, name) adds the column's value in the row before, null in a key's first row.
    """
    kept = [c for c in df.columns if c not in (position, total)]
    key = F.xxhash64(*(F.col(k) for k in keys))
    # at most HEAVY_KEYS numbers, without bearing on the result
    top = df.select(key.alias("h")).agg(F.expr(f"approx_top_k(h, {HEAVY_KEYS}, {SKETCH_ITEMS})").alias("top"))
    heavy = [r["h"] for r in top.select(F.explode("top").alias("x")).where(F.col("x.count") >= HEAVY_ROWS)
             .select(F.col("x.item").alias("h")).collect()]
    is_heavy = key.isin(heavy)
    ties = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name in kept and f.name not in keys and isinstance(f.dataType, T.AtomicType)]
    light = df.where(~is_heavy) if heavy else df
    group = Window.partitionBy(*keys)
    out = light.select(*(F.col(f"`{c}`") for c in kept),
                       F.row_number().over(group.orderBy(*order, *ties)).cast("long").alias(position),
                       *([F.count(F.lit(1)).over(group).alias(total)] if total else []),
                       *([F.lag(previous[0]).over(group.orderBy(*order, *ties)).alias(previous[1])] if previous else []))
    if not heavy:
        return out
    rest = with_positions(df.where(is_heavy), keys, [*order, *ties], position, total)
    if previous:
        # by position: keys and position are even, whatever a key's share of the rows
        before = rest.select(*(F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)), (F.col(position) + 1).alias("_at"), F.col(previous[0]).alias(previous[1]))
        on = F.col(position) == F.col("_at")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_b{i}"))
        rest = rest.join(before, on, "left").select(*rest.columns, previous[1])
    return out.union(rest)
