"""Removal of repeated substrings by window equality in suffix order.

A byte is removed if a string of ``LENGTH`` bytes that covers it (a window) also starts elsewhere.

Sorting all suffixes of a corpus would move every byte hundreds of times, so windows are first dealt
out by content.  Each window has an anchor, the least-hashed 16-byte gram in it; neighbouring windows
share anchors.  Windows with one anchor are cut into runs of at most ``RUN`` starts at fixed offsets
from it; all windows of a run contain the run's core of ``LENGTH - RUN + 1`` bytes.  Equal windows
have equal anchors at equal offsets, so they lie in runs with equal cores: a run whose core occurs
once holds no repeated window.  Runs with equal cores and equal edges repeat as a whole and are settled
by counting.  What is left are runs with equal cores and different edges: one run of each kind sends its
edges (under 2 * RUN bytes) to the task of the core, which ranks the stretches at the window starts by
prefix doubling.  Windows that are equal over the whole length stand in text order: whether one has an equal before or
behind it is all that a byte's fate depends on, so no factor lengths are computed.

A core with more than ``HOT`` kinds of edges is not sorted in one task: its runs are cut into runs
of ``FINE`` starts, settled the same way, and the rest window by window with aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tastegrid.llm.common import documents, query, saved, shielded, text_or_empty

LENGTH = 400
GRAM = 16
RUN, FINE = 128, 16
HOT = 2_048
#: Window starts whose anchors are sought at once, and bytes of edges that are sorted at once.
PIECE, SORTED_BYTES = 1 << 20, 3_000_000

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xBF58476D1CE4E5B9)
_PLACE = 28  # bits that hold a position within a piece


def _loads(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first ``n`` positions as a number (``data`` has n + 7 bytes at least)."""
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        count = (n - o + 7) // 8
        out[o::8] = np.frombuffer(data[o:o + 8 * count].tobytes(), "<u8")
    return out


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    x = _loads(data, n + 8)
    h = x[:n] * _A
    h ^= h >> _U(29)
    h += x[8:] * _B
    h ^= h >> _U(32)
    h *= _C
    return h


def anchors(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window start the position of its least-hashed gram (the first of equals)."""
    starts, grams = len(data) - length + 1, length - GRAM + 1
    out = np.empty(max(0, starts), np.int64)
    for lo in range(0, starts, PIECE):
        hi = min(starts, lo + PIECE)
        h = _gram_hashes(data[lo:hi + length - 1])
        packed = (h >> _U(_PLACE)) << _U(_PLACE) | np.arange(len(h), dtype=np.uint64)
        # sliding minimum: the least to the right and to the left of fixed borders
        rows = -(-len(packed) // grams)
        grid = np.full(rows * grams, np.iinfo(np.uint64).max, np.uint64)
        grid[:len(packed)] = packed
        grid = grid.reshape(rows, grams)
        right = np.minimum.accumulate(grid, axis=1).reshape(-1)
        left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(left[:hi - lo], right[grams - 1:grams - 1 + hi - lo])
        out[lo:hi] = (least & _U((1 << _PLACE) - 1)).astype(np.int64) + lo
    return out


def runs(start: np.ndarray, anchor: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(core, lo, hi) of the runs of windows ``start`` with ``anchor``: the windows core - hi to core - lo."""
    behind = anchor - start
    block = behind // run
    core = anchor - block * run
    new = np.empty(len(start), bool)
    new[:1] = True
    new[1:] = (np.diff(core) != 0) | (np.diff(anchor) != 0) | (np.diff(start) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return core[first], (core[last] - start[last]), (core[first] - start[first])


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, bytes]]:
    for i, t in enumerate(batch.column(column)):
        if t.is_valid:
            yield i, t.as_buffer().to_pybytes()


def _run_rows(text: bytes, length: int) -> tuple[list[int], list[int], np.ndarray]:
    """Keys (core), edge hashes and packed places of a text's runs."""
    import xxhash

    if len(text) < length:
        return [], [], np.empty(0, np.int64)
    digest, inner = xxhash.xxh3_64_intdigest, length - RUN + 1
    data = np.frombuffer(text + b"\0" * 16, np.uint8)[:len(text)]
    at = anchors(data, length)
    core, lo, hi = runs(np.arange(len(at)), at, RUN)
    spans = list(zip(core.tolist(), lo.tolist(), hi.tolist(), (at[core - hi] - core).tolist(), strict=True))
    keys = [digest(text[c:c + inner], b) for c, _, _, b in spans]
    edges = [digest(text[c - h:c - l + length], (l << 8) | h) for c, l, h, _ in spans]
    return keys, edges, core << 16 | lo << 8 | hi


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _run_table(docs: DataFrame, length: int, places: bool) -> DataFrame:
    """Rows (key, edge) of all runs, with ``places`` also (doc, version, place)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, edges, place, row = [], [], [], []

            def out(b=b) -> pa.RecordBatch:
                cols = {"key": _signed(keys), "edge": _signed(edges)}
                if places:
                    take = pa.array(np.concatenate(row))
                    cols |= {"doc": b.column(0).take(take), "version": b.column(1).take(take),
                             "place": pa.array(np.concatenate(place))}
                return pa.RecordBatch.from_pydict(cols)

            for i, t in _texts(b, 2):
                k, e, p = _run_rows(t, length)
                if k:
                    keys += k
                    edges += e
                    place.append(p)
                    row.append(np.full(len(k), i))
                    if len(keys) > 50_000:
                        yield out()
                        keys, edges, place, row = [], [], [], []
            if keys:
                yield out()

    schema = "key bigint, edge bigint" + ", doc bigint, version bigint, place bigint" * places
    return docs.mapInArrow(run, schema)


def _ranks(data: np.ndarray, width: int) -> np.ndarray:
    """Rank of the suffix at each position by its first ``width`` (a power of two, 8 at least) bytes."""
    rank = np.unique(_loads(data, len(data) - 8).byteswap(), return_inverse=True)[1]
    have = 8
    while have < width:
        shifted = np.zeros_like(rank)
        shifted[:-have] = rank[have:]
        rank = np.unique(rank << 32 | shifted, return_inverse=True)[1]
        have *= 2
    return rank


def equal_windows(edges: list[bytes], keys: np.ndarray, lo: np.ndarray, hi: np.ndarray,
                     run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of runs, given by their edges in text order: (run, offset, earlier, later).

    The windows of a run are its offsets 0 to hi - lo; they differ from others with the same key and place
    by the run - 1 bytes of the edges from there on.  earlier says that an equal window stands before, later that one
    stands behind.
    """
    width = 1 << (run - 1).bit_length() - 1  # two stretches of this width cover run - 1 bytes
    begin = np.cumsum([0] + [len(e) for e in edges])
    data = np.frombuffer(b"".join(edges) + b"\0" * (2 * run + 16), np.uint8)
    rank = _ranks(data, width)
    count = hi - lo + 1
    of = np.repeat(np.arange(len(edges)), count)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[of] + offset
    # equal means: the same core at the same distance, and the same edge bytes
    same = np.unique(rank[at] << 32 | rank[at + run - 1 - width], return_inverse=True)[1]
    spot = np.unique(keys, return_inverse=True)[1][of] * 256 + hi[of] - offset
    order = np.lexsort((same, spot))  # stable: equal ones stay in text order
    equal = (np.diff(same[order]) == 0) & (np.diff(spot[order]) == 0)
    earlier, later = np.zeros(len(of), bool), np.zeros(len(of), bool)
    earlier[order[1:]] = equal
    later[order[:-1]] = equal
    return of, offset, earlier, later


def _spans(of: np.ndarray, offset: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of hit windows: (run, first offset, last offset)."""
    of, offset = of[hit], offset[hit]
    new = np.ones(len(of), bool)
    new[1:] = (np.diff(of) != 0) | (np.diff(offset) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(of)) - 1
    return of[first], offset[first], offset[last]


def _wanted_edges(asked: DataFrame, at: tuple[int, ...], length: int) -> DataFrame:
    """Rows (key, doc, version, place, edges) of the runs asked of each text; ``at``: doc, version, text, wanted."""
    inner = length - RUN + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, version, wanted = (b.column(at[c]).to_pylist() for c in (0, 1, 3))
            for i, t in _texts(b, at[2]):
                key, place = [w["key"] for w in wanted[i]], [w["place"] for w in wanted[i]]
                edges = []
                for p in place:
                    c, l, h = p >> 16, p >> 8 & 255, p & 255
                    edges.append(t[c - h:c] + t[c + inner:c - l + length])
                n = len(key)
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(key, pa.int64()), "doc": pa.array([doc[i]] * n, pa.int64()),
                    "version": pa.array([version[i]] * n, pa.int64()), "place": pa.array(place, pa.int64()),
                    "edges": pa.array(edges, pa.binary())})

    return asked.mapInArrow(run, "key bigint, doc bigint, version bigint, place bigint, edges binary")


def _sorted_spans(edges: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Rows (doc, version, start, end) that the sorted suffixes of each core give; whole cores per task."""
    def settle(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))  # text order
        key, place = (np.array([r[c] for r in rows], np.int64) for c in (0, 3))
        core, lo, hi = place >> 16, place >> 8 & 255, place & 255
        of, offset, earlier, later = equal_windows([r[4] for r in rows], key, lo, hi)
        of, a, z = _spans(of, offset, earlier if keep_first else earlier | later)
        start = core[of] - hi[of]
        return pa.RecordBatch.from_pydict({
            "doc": pa.array([rows[i][1] for i in of.tolist()], pa.int64()),
            "version": pa.array([rows[i][2] for i in of.tolist()], pa.int64()),
            "start": pa.array(start + a), "end": pa.array(start + z + length)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, before = [], 0, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:4] == before:  # the same run of a repeated row
                    continue
                if size >= SORTED_BYTES and r[0] != before[0]:
                    yield settle(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4])
                before = r[:4]
        if rows:
            yield settle(rows)

    dealt = edges.repartition("key").sortWithinPartitions("key", "doc", "version", "place")
    return dealt.mapInArrow(run, "doc bigint, version bigint, start bigint, end bigint")


def _fine_rows(asked: DataFrame, at: tuple[int, ...], length: int) -> DataFrame:
    """The runs asked of each text cut into runs of ``FINE`` starts: (key, doc, version, place, edges)."""
    inner = length - FINE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            doc, version, wanted = (b.column(at[c]).to_pylist() for c in (0, 1, 3))
            for i, t in _texts(b, at[2]):
                keys, place, edges = [], [], []
                for w in wanted[i]:
                    core, lo, hi = w["place"] >> 16, w["place"] >> 8 & 255, w["place"] & 255
                    for k in range(lo // FINE, hi // FINE + 1):
                        c, l, h = core - k * FINE, max(0, lo - k * FINE), min(FINE - 1, hi - k * FINE)
                        keys.append(digest(t[c:c + inner], (w["key"] + k) % 2**64))
                        place.append(c << 16 | l << 8 | h)
                        edges.append(t[c - h:c] + t[c + inner:c - l + length])
                n = len(keys)
                yield pa.RecordBatch.from_pydict({
                    "key": _signed(keys), "doc": pa.array([doc[i]] * n, pa.int64()),
                    "version": pa.array([version[i]] * n, pa.int64()), "place": pa.array(place, pa.int64()),
                    "edges": pa.array(edges, pa.binary())})

    return asked.mapInArrow(run, "key bigint, doc bigint, version bigint, place bigint, edges binary")


def _core(place: Column | str) -> Column:
    return F.shiftright(place, 16)


def _hi(place: Column | str) -> Column:
    return F.col(place).bitwiseAND(F.lit(255))


def _lo(place: Column | str) -> Column:
    return F.shiftright(place, 8).bitwiseAND(F.lit(255))


def _whole(rows: DataFrame, length: int) -> DataFrame:
    """The spans of whole runs."""
    return rows.select("doc", "version", (_core("place") - _hi("place")).alias("start"),
                       (_core("place") - _lo("place") + length).alias("end"))


def _counted_spans(fine: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Spans of the fine runs by aggregates alone, whatever their number per core."""
    fine = saved(fine.distinct())
    shape = F.col("place").bitwiseAND(F.lit(65_535)).alias("shape")
    me = F.struct(F.col("doc").isNull().alias("no_doc"), "doc", "version", "place")
    kinds = fine.groupBy("key", shape, "edges").agg(F.count(F.lit(1)).alias("n"), F.min(me).alias("first"))
    copies = fine.withColumn("shape", shape).join(kinds.where("n > 1"), ["key", "shape", "edges"])
    if keep_first:
        copies = copies.where(me != F.col("first"))
    one = kinds.select("key", "edges", "first", "first.doc", "first.version", "first.place")
    mixed = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("key")
    windows = (one.join(mixed, "key").withColumn("back", F.explode(F.sequence(_lo("place"), _hi("place"))))
               .withColumn("around", F.substring("edges", (_hi("place") - F.col("back") + 1).cast("int"), F.lit(FINE - 1))))
    equal = windows.groupBy("key", "back", "around").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("least"))
    hit = windows.join(equal.where("n > 1"), ["key", "back", "around"])
    if keep_first:
        hit = hit.where(F.col("first") != F.col("least"))
    start = _core("place") - F.col("back")
    return _whole(copies, length).union(hit.select("doc", "version", start.alias("start"), (start + length).alias("end")))


def repeated_spans(docs: DataFrame, base: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """Rows (doc, version, start, end), overlapping ones too, that cover the repeated bytes.

    ``docs`` has (doc, version, text); ``base`` the same as _doc, _version, _text among its columns, in the
    form in which the spans will be joined to it.
    """
    # written, so that the join has a plain shuffle on both sides, whose hot keys Spark can split
    counts = saved(_run_table(docs, length, False).groupBy("key")
                   .agg(F.count(F.lit(1)).alias("n"), (F.min("edge") != F.max("edge")).alias("mixed"))
                   .where("n > 1").select("key", "mixed"))
    members = saved(_run_table(docs, length, True).join(counts, "key"))
    me = F.struct(F.col("doc").isNull().alias("no_doc"), "doc", "version", "place")
    kinds = members.groupBy("key", "edge", "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(me).alias("first"))
    if keep_first:
        copies = members.join(kinds.where("n > 1").select("key", "edge", "first"), ["key", "edge"]).where(me != F.col("first"))
        found = _whole(copies, length)
    else:
        copies = members.where("mixed").join(kinds.where("mixed AND n > 1").select("key", "edge"), ["key", "edge"], "left_semi")
        found = _whole(members.where("NOT mixed"), length).union(_whole(copies, length))
    apart = kinds.where("mixed").select("key", "first.doc", "first.version", "first.place")
    hot = saved(apart.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > HOT).select("key"))

    def ask(rows: DataFrame) -> tuple[DataFrame, tuple[int, ...]]:
        wanted = (rows.groupBy(F.col("doc").alias("_of"), F.col("version").alias("_in"))
                  .agg(F.collect_list(F.struct("key", "place")).alias("_wanted")))
        asked = base.join(wanted,
                          base["_doc"].eqNullSafe(wanted["_of"]) & (base["_version"] == wanted["_in"])).drop("_of", "_in")
        return asked, tuple(asked.columns.index(c) for c in ("_doc", "_version", "_text", "_wanted"))

    if hot.isEmpty():
        return found.union(_sorted_spans(_wanted_edges(*ask(apart), length), length, keep_first))
    sorted_ = _sorted_spans(_wanted_edges(*ask(apart.join(hot, "key", "left_anti")), length), length, keep_first)
    fine = _counted_spans(_fine_rows(*ask(apart.join(hot, "key", "left_semi")), length), length, keep_first)
    return found.union(sorted_).union(fine)


@shielded("doc_id", "text")
def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   keep_first: bool = False) -> DataFrame:
    """``df`` with columns kept (binary), n_bytes, n_removed (long) and spans (array of start and end).

    Texts are UTF-8 bytes, null is empty; a window of ``length`` bytes (256 at least) lies within one row.
    Bytes of windows that start at two places or more, in any rows, are removed from all places, or with
    ``keep_first`` from all but the first by (id, place).  Rows with the same id and text are
    indistinguishable: each is a place of its own, and with ``keep_first`` equal rows are treated alike (the
    first place stays in all).  Null ids come after all others.  spans are the removed bytes, maximal and in
    order; kept may cut characters.  Columns of the added names are replaced, others carried, whatever their names.  Every row
    stays; an empty table gives an empty table.
    """
    if length < 2 * RUN:
        raise ValueError(f"length must be at least {2 * RUN}")
    df = df.drop("kept", "n_bytes", "n_removed", "spans")
    names = df.columns
    base = df.withColumns({"_doc": F.col(doc_id).cast("long"), "_version": F.xxhash64(text_or_empty(text)),
                           "_text": text_or_empty(text)})
    docs = base.select(F.col("_doc").alias("doc"), F.col("_version").alias("version"), F.col("_text").alias("text"))
    spans = repeated_spans(docs, base, length, keep_first)
    by_doc = (spans.groupBy(F.col("doc").alias("_of"), F.col("version").alias("_in"))
              .agg(F.collect_list(F.struct("start", "end")).alias("_found")))
    joined = base.join(by_doc,
                       base["_doc"].eqNullSafe(by_doc["_of"]) & (base["_version"] == by_doc["_in"]), "left").drop("_of", "_in")
    at = [joined.columns.index(c) for c in ("_text", "_found")]
    carried = [joined.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, size, gone, out = [], [], [], []
            for t, found in zip(b.column(at[0]), b.column(at[1]).to_pylist(), strict=True):
                raw = t.as_buffer().to_pybytes()
                merged: list[list[int]] = []
                for s, e in sorted((f["start"], f["end"]) for f in found or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                edge = [0, *(x for m in merged for x in m), len(raw)]
                kept.append(b"".join(raw[edge[i]:edge[i + 1]] for i in range(0, len(edge), 2)))
                size.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
                out.append([{"start": s, "end": e} for s, e in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in carried), pa.array(kept, pa.binary()), pa.array(size, pa.int64()),
                 pa.array(gone, pa.int64()), pa.array(out, kind)],
                names=[*names, "kept", "n_bytes", "n_removed", "spans"])

    have = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    added = "kept binary, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>"
    return joined.mapInArrow(run, f"{have}, {added}")


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, removed and kept bytes, removed runs, and the digest of what is left."""
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
