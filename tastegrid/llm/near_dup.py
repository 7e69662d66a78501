"""Near-duplicate documents by SetSketch registers.

A document is the set of its word shingles (64-bit hashes).  Documents with equal sets form a
class, known by a 128-bit digest; all later steps work on one sketch per class, so copies cost
nothing however many there are.

A sketch has ``REGISTERS`` registers.  Register i is the least of independent exponential hashes
of the shingles, written as a truncated integer logarithm to base ``BASE``: sketches of unions are
registerwise maxima, and with a base near 1 two registers agree with a probability near the
Jaccard similarity.  Bands of registers are hashed into buckets; pairs in a bucket are judged by
the likelihood of their register orders given both set sizes, and what may reach the threshold is
verified on the full sets.

Links only have to connect.  First every class is tried with the least digest of each of its
buckets, its hub.  Buckets whose classes are then connected are done.  In the others all pairs are
settled: each class is written as its difference from the hub's set, a task counts what two differences
share, which gives the exact similarity of every pair, and reports a link for each two parts that
belong together (large buckets go in blocks).  No pairs are written but those links.  Connected
components come from alternating star operations.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tastegrid.llm.common import documents, query, saved, shielded, text_or_empty

BANDS, BAND_ROWS = 24, 4
REGISTERS = 128
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: Estimates so many standard deviations under the threshold still go to verification.
MARGIN = 4.5
EDGES_PER_PARTITION = 200_000
#: Members of a bucket that are compared with as many others at once, and columns of what they share.
BLOCK, COLUMNS = 2_048, 8_192

_U = np.uint64
_CONST = np.random.default_rng(20_240_607).integers(1, 2**63, size=(2, REGISTERS), dtype=np.uint64)
_MULTIPLY, _ADD = (_CONST[0] << _U(1)) | _U(1), _CONST[1]
_MULTIPLY32, _ADD32 = (_CONST[0] >> _U(31)).astype(np.uint32) | np.uint32(1), _CONST[1].astype(np.uint32)
_MIX, _MIX32 = _U(0xBF58476D1CE4E5B9), np.uint32(0x85EBCA6B)
#: Words whose hashes a task keeps.
KNOWN_WORDS = 250_000
ROWS_AT_ONCE = 128  # the working arrays stay in the processor's cache


class Shingler:
    """Sets of shingle hashes; word hashes are kept between texts."""

    def __init__(self, k: int):
        import xxhash

        self.k, self.digest, self.known = k, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct hashes of the k-word shingles, sorted; of the whole sequence if it is shorter."""
        words = (text or "").encode().lower().split()  # on bytes both touch ASCII alone
        if not words:
            return np.empty(0, np.uint64)
        known, digest = self.known, self.digest
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = digest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                out = (out ^ h[i:i + n]) * _MIX
                out ^= out >> _U(29)
        return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a set of hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    short = (hashes ^ (hashes >> _U(32))).astype(np.uint32)
    x = np.empty((ROWS_AT_ONCE, REGISTERS), np.uint32)
    y = np.empty_like(x)
    for at in range(0, len(short), ROWS_AT_ONCE):
        some = short[at:at + ROWS_AT_ONCE, None]
        u, v = x[:len(some)], y[:len(some)]
        np.multiply(some, _MULTIPLY32, out=u)
        u += _ADD32
        np.right_shift(u, 15, out=v)
        u ^= v
        u *= _MIX32
        np.minimum(least, u.min(axis=0), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)) + TOP // 4, 0, TOP).astype("<u2")


def similarity(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood Jaccard similarity and its standard deviation.

    ``above`` and ``below`` count the registers in which a's is the greater or the smaller one.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    c = (BASE - 1) / BASE
    log_b = math.log(BASE)
    prob = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * c) / log_b
    slope = lambda x: c / (1 - np.clip(x, 1e-9, 1) * c) / log_b
    same = REGISTERS - above - below
    low, high = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(24):  # the derivative of the log-likelihood falls with the similarity
        j = (low + high) / 2
        p, q = prob(u - v * j), prob(v - u * j)
        dp, dq = -v * slope(u - v * j), -u * slope(v - u * j)
        rest = np.maximum(1 - p - q, 1e-9)
        grad = above * dp / np.maximum(p, 1e-9) + below * dq / np.maximum(q, 1e-9) - same * (dp + dq) / rest
        low, high = np.where(grad > 0, j, low), np.where(grad > 0, high, j)
    j = (low + high) / 2
    p, q = np.maximum(prob(u - v * j), 1e-3), np.maximum(prob(v - u * j), 1e-3)
    dp, dq = -v * slope(u - v * j), -u * slope(v - u * j)
    info = dp * dp / p + dq * dq / q + (dp + dq) ** 2 / np.maximum(1 - p - q, 1e-3)
    return j, 1 / np.sqrt(REGISTERS * info)


def may_reach(regs_a, regs_b, n_a, n_b, threshold: float) -> np.ndarray:
    """Whether pairs of sketches may have at least the threshold's similarity."""
    above = (regs_a > regs_b).sum(axis=-1).astype(np.float64)
    below = (regs_a < regs_b).sum(axis=-1).astype(np.float64)
    n_a, n_b = np.broadcast_arrays(n_a.astype(np.float64), n_b.astype(np.float64))
    sizes = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)
    out = np.zeros(above.shape, bool)
    near = sizes & (REGISTERS - above - below >= REGISTERS * threshold / 2)
    if near.any():
        # the deviation at the threshold, where a pair to be found lies at least
        j, sd = similarity(above[near], below[near], n_a[near], n_b[near])
        worst = math.sqrt(threshold * (1 - threshold) / REGISTERS)
        out[near] = j + MARGIN * np.maximum(sd, worst) >= threshold
    return out


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def sketches(df: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, version, n, digest, regs), one for each row of ``df``; digest and regs are null for empty sets."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                     F.xxhash64(text_or_empty(text)).alias("version"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)
        for b in batches:
            n, digest, regs = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py())
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield _batch({"doc_id": b.column(0), "version": b.column(2), "n": pa.array(n, pa.int64()),
                          "digest": pa.array(digest, pa.binary()), "regs": pa.array(regs, pa.binary())})

    return docs.mapInArrow(run, "doc_id bigint, version bigint, n bigint, digest binary, regs binary")


def _bands(classes: DataFrame) -> DataFrame:
    """Rows (bucket, digest): one for each band of each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _MULTIPLY[:BAND_ROWS]
        for b in batches:
            if not b.num_rows:
                continue
            regs = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, REGISTERS)
            regs = regs[:, :BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS)
            h = (regs.astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64) + _ADD[:BANDS]
            h = (h ^ (h >> _U(31))) * _MIX
            h ^= h >> _U(30)
            yield _batch({"bucket": pa.array(h.reshape(-1).view(np.int64)),
                          "digest": b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))})

    return classes.select("digest", "regs").mapInArrow(run, "bucket bigint, digest binary")


def _estimated(pairs: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) rows of ``pairs`` (a, b, n_a, regs_a, n_b, regs_b) that may reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n_a, n_b = (b.column(c).to_numpy() for c in ("n_a", "n_b"))
            regs = [np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS)
                    for c in ("regs_a", "regs_b")]
            keep = pa.array(may_reach(*regs, n_a, n_b, threshold))
            yield _batch({c: b.column(c).filter(keep) for c in ("a", "b")})

    return pairs.select("a", "b", "n_a", "regs_a", "n_b", "regs_b").mapInArrow(run, "a binary, b binary")


def _with_sketches(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    one = lambda s: classes.select(F.col("digest").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}"))
    return pairs.join(one("a"), "a").join(one("b"), "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) rows whose full sets have the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield _batch({c: b.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")})

    one = lambda s: sets.select(F.col("digest").alias(s), F.col("hashes").alias(f"set_{s}"))
    return (pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "set_a", "set_b")
            .mapInArrow(run, "a binary, b binary"))


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (digest, hub, n_hub, missing, extra) for (digest, hub): what the set lacks of the hub's, and has besides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, missing, extra = [], [], []
            for x, y in zip(b.column("own"), b.column("hubs"), strict=True):
                s, h = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                n.append(len(h))
                missing.append(np.flatnonzero(~np.isin(h, s, assume_unique=True)).astype("<u4").tobytes())
                extra.append(s[~np.isin(s, h, assume_unique=True)].tobytes())
            yield _batch({"digest": b.column("digest"), "hub": b.column("hub"), "n_hub": pa.array(n, pa.int64()),
                          "missing": pa.array(missing, pa.binary()), "extra": pa.array(extra, pa.binary())})

    joined = (pairs.join(sets.select("digest", F.col("hashes").alias("own")), "digest")
              .join(sets.select(F.col("digest").alias("hub"), F.col("hashes").alias("hubs")), "hub"))
    return joined.select("digest", "hub", "own", "hubs").mapInArrow(
        run, "digest binary, hub binary, n_hub bigint, missing binary, extra binary")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many numbers each array of ``left`` shares with each of ``right``."""
    a, b = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (left, right))
    known = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    place = lambda rows: np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    row_a, row_b = place(left), place(right)
    hit_a, hit_b = np.isin(a, known), np.isin(b, known)
    row_a, col_a = row_a[hit_a], np.searchsorted(known, a[hit_a])
    row_b, col_b = row_b[hit_b], np.searchsorted(known, b[hit_b])
    for at in range(0, len(known), COLUMNS):
        width = min(COLUMNS, len(known) - at)
        m, w = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        in_a, in_b = (col_a >= at) & (col_a < at + width), (col_b >= at) & (col_b < at + width)
        m[row_a[in_a], col_a[in_a] - at] = 1
        w[row_b[in_b], col_b[in_b] - at] = 1
        out += m @ w.T
    return out


def _links_in_block(rows: list[dict], percent: int) -> list[tuple[bytes, bytes]]:
    """A link between each two parts with a linked pair, as far as they connect parts anew."""
    i, j, n_hub = rows[0]["i"], rows[0]["j"], rows[0]["n_hub"]
    features, lacks, sizes = [], [], []
    for r in rows:
        missing, extra = np.frombuffer(r["missing"], "<u4"), np.frombuffer(r["extra"], "<u8")
        # places in the hub's set stand for themselves, other hashes for the rest
        features.append(np.concatenate([missing.astype(np.uint64), extra | _U(1 << 32)]))
        lacks.append(len(missing))
        sizes.append(n_hub - len(missing) + len(extra))
    own = np.array([r["own"] for r in rows])
    at_l, at_r = np.flatnonzero(own == i), np.flatnonzero(own == j)
    part = np.unique([r["part"] for r in rows], return_inverse=True)[1]
    lacks, sizes = np.array(lacks, np.int64), np.array(sizes, np.int64)
    both = _shared([features[k] for k in at_l], [features[k] for k in at_r]).astype(np.int64)
    both += n_hub - lacks[at_l][:, None] - lacks[at_r][None, :]
    union = sizes[at_l][:, None] + sizes[at_r][None, :] - both
    x, y = np.nonzero((100 * both >= percent * union) & (part[at_l][:, None] != part[at_r][None, :]))
    root = list(range(int(part.max()) + 1))

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    out = []
    code = part[at_l[x]] * len(root) + part[at_r[y]]
    for k in np.unique(code, return_index=True)[1].tolist():
        a, b = at_l[x[k]], at_r[y[k]]
        p, q = find(int(part[a])), find(int(part[b]))
        if p != q:
            root[p] = q
            out.append((rows[a]["digest"], rows[b]["digest"]))
    return out


def _cross_links(bands: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b): links of one bucket between classes that are not connected yet, enough to connect them."""
    placed = bands.join(labels, "digest", "left").withColumn("part", F.coalesce("label", "digest")).drop("label")
    mixed = (placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("part").alias("x"), F.max("part").alias("y"))
             .where(F.col("x") < F.col("y")).select("bucket", "size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("digest"), F.col("blocks").cast("long")).cast("int")
    rows = placed.join(mixed, "bucket").withColumn("blocks", blocks).withColumn("own", own)
    rows = rows.join(_differences(rows.select("digest", "hub").distinct(), sets), ["digest", "hub"])
    rows = (rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
            .select("bucket", "i", "j", "digest", "part", "own", "n_hub", "missing", "extra"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now = [], None

        def out() -> pa.RecordBatch:
            links = _links_in_block(group, percent) if len(group) > 1 else []
            return _batch({"a": pa.array([min(p) for p in links], pa.binary()),
                           "b": pa.array([max(p) for p in links], pa.binary())})

        for b in batches:
            for r in b.to_pylist():
                key = (r["bucket"], r["i"], r["j"])
                if key != now:
                    if group:
                        yield out()
                    group, now = [], key
                group.append(r)
        if group:
            yield out()

    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (digest, label) of the nodes of ``edges`` (a, b): label is the least node reachable.

    Alternating large-star and small-star steps, each a join with a least-neighbour aggregate; the
    edges of every round are written to the checkpoint folder.
    """
    def turned(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    def kept(rows: DataFrame) -> tuple[DataFrame, tuple]:
        """The written edges, in as many partitions as their number asks for, and what tells them from others."""
        written = saved(rows.where(F.col("a") != F.col("b")).distinct())
        seen = mark(written)
        return written.coalesce(1 + seen[0] // EDGES_PER_PARTITION), seen

    e, before = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while before[0]:
        both = turned(e)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        e1, _ = kept(large)
        low = e1.groupBy("a").agg(F.min("b").alias("m"))
        small = e1.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e, after = kept(small)
        if after == before:
            break
        before = after
    leaves = e.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("digest"), "label")
    roots = e.select(F.col("b").alias("digest"), F.col("b").alias("label")).distinct()
    return leaves.union(roots)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per row of ``df``: doc_id (long), version (hash of the text), n_shingles, component_id, kept.

    Rows whose shingle sets have 100 * intersection >= ``percent`` * union are linked; component_id
    is the least id reachable, kept says that it is the row's own.  Null and empty texts, and texts
    without words, have empty sets and no links.  Rows that share an id each have their own links; equal
    rows are in one component and both carry its id.  Null ids are linked like others but are never
    the least; a component of null ids alone has component_id null and all its rows are kept.  Other
    columns are not carried.  An empty table gives an empty table.
    """
    threshold = percent / 100
    base = saved(sketches(df, k, doc_id, text))
    classes = saved(base.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("least_id"), F.max("n").alias("n"), F.max("regs").alias("regs")))
    bands = _bands(classes)
    shared = bands.groupBy("bucket").agg(F.min("digest").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    bands = saved(bands.join(shared.drop("size"), "bucket"))
    tries = bands.where("digest <> hub").select(F.col("hub").alias("a"), F.col("digest").alias("b")).distinct()
    tries = _estimated(_with_sketches(tries, classes), threshold)
    sets = saved(_sets(df, bands.select("digest").distinct(), base, k, doc_id, text))
    links = saved(_verified(tries, sets, percent))
    labels = saved(components(links))
    more = saved(_cross_links(bands, labels, sets, percent))
    if not more.isEmpty():
        labels = saved(components(links.union(more)))
    by_class = classes.select("digest", "least_id").join(labels, "digest", "left")
    by_class = by_class.withColumn("label", F.coalesce("label", "digest"))
    least = by_class.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = by_class.join(least, "label").select("digest", "component_id")
    out = base.select("doc_id", "version", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "version", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


@shielded("doc_id", "text")
def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5,
                         percent: int = 80) -> DataFrame:
    """``df`` with one document of each component, the one with the least id; rows with equal id and text are one.

    Null and empty texts stay; see ``near_duplicates`` for null and shared ids.  Other columns are carried, whatever their names.
    """
    key = ["_id", "_no_id", "_version"]
    found = near_duplicates(df, doc_id, text, k, percent).where("kept")
    found = found.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_no_id"),
                         F.col("version").alias("_version")).distinct()
    docs = df.withColumns({"_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)),
                           "_no_id": F.col(doc_id).cast("long").isNull(), "_version": F.xxhash64(text_or_empty(text))})
    return docs.join(found, key, "left_semi").dropDuplicates(key).select(*df.columns)


def _sets(df: DataFrame, members: DataFrame, base: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """Rows (digest, hashes): the full set of each member, from the text of one document that has it."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    wanted = (base.join(members, "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("doc_id")))
    found = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"])).select("digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)
        for b in batches:
            digest, hashes = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(t.as_py())
                if len(s) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d:
                    digest.append(d)
                    hashes.append(s.tobytes())
            yield _batch({"digest": pa.array(digest, pa.binary()), "hashes": pa.array(hashes, pa.binary())})

    return (found.mapInArrow(run, "digest binary, hashes binary").groupBy("digest")
            .agg(F.max("hashes").alias("hashes")))


@query("op9_near_dup")
def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on three-word shingles at 0.85."""
    return near_duplicates(documents(spark, sf_dir), k=3, percent=85).drop("version")
