"""URL filter by host and path rules with a cascade of Bloom filters.

A rule is a host and a path prefix.  Every url has a bounded set of candidate keys: each
suffix of its host at a label border, joined with each path prefix whose length some rule of
that list has.  The distinct candidate keys of the whole corpus are the key universe.  Level 1
of a cascade encodes the listed keys; level 2 the keys of the universe that level 1 takes for
listed by mistake; level 3 the listed keys that level 2 takes for mistakes, and so on until a
level makes no mistake over the universe.  The number of levels a key passes then tells its
membership exactly, so urls are judged row by row, without a join.

The filters' bits are gathered in Spark, in blocks, and sent to the tasks as byte arrays (about 1.5 bytes a listed key
for each factor of ten by which the universe is larger); no size is refused and none stands in the plan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tastegrid.llm.common import query, saved, shielded
from tastegrid.sources.tables import read_table


class Rule(NamedTuple):
    verdict: str  # "block" or "allow"
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

#: 64-bit words of a filter that travel as one row.
BLOCK_WORDS = 1 << 13
_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xBF58476D1CE4E5B9)


class Level(NamedTuple):
    bits: int
    hashes: int
    words: np.ndarray  # the bits, 64 a word


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and for a url without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + F.lit(3), F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """All keys under which a rule with a path of one of ``lengths`` could fit, the longest first.

    Keys are ``host suffix + NUL + path prefix`` (no rule host holds NUL).  Without a host or path
    the array is empty or short; ties in length go to the longer host.
    """
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*[
        F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])) if lengths else F.array()
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(
        prefixes, lambda p: F.struct((-(F.length(s) + F.length(p))).alias("n"), (-F.length(s)).alias("h"),
                                     F.concat(s, F.lit("\0"), p).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda p: p["key"])


def _rule_key(rule: Rule) -> str:
    return rule.host + "\0" + rule.path


def _hashed(keys: DataFrame) -> DataFrame:
    """(key, h1, h2) of distinct keys."""
    return keys.select("key", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"))


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ (_U(salt + 1) * _A)) * _B
    h ^= h >> _U(32)
    h *= _C
    return h ^ h >> _U(29)


def bit_places(h1: np.ndarray, h2: np.ndarray, salt: int, bits: int, hashes: int) -> np.ndarray:
    """(hashes, keys): the bits of each key at the level ``salt``."""
    a, b = _mix(h1.view(_U), salt), _mix(h2.view(_U), salt) | _U(1)
    return (a + np.arange(hashes, dtype=_U)[:, None] * b) % _U(bits)


def passes(level: Level, salt: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    at = bit_places(h1, h2, salt, level.bits, level.hashes)
    return ((level.words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1)).all(axis=0)


def _level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """Bloom filter of the ``n`` rows of ``keys`` (h1, h2) with false-positive rate ``rate``.

    The bits are set by an aggregation over the words of the filter; what reaches the driver is the filter itself,
    in blocks.
    """
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, math.ceil(n * hashes / math.log(2) / 64) * 64)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = bit_places(b.column(0).to_numpy(), b.column(1).to_numpy(), salt, bits, hashes).reshape(-1)
            yield pa.RecordBatch.from_pydict({"word": pa.array((at >> _U(6)).astype(np.int64)),
                                              "v": pa.array((_U(1) << (at & _U(63))).view(np.int64))})

    def block(table: pa.Table) -> pa.Table:
        word = table["word"].to_numpy()
        out = np.zeros(BLOCK_WORDS, np.int64)
        out[word % BLOCK_WORDS] = table["v"].to_numpy()
        return pa.table({"block": pa.array([int(word[0]) // BLOCK_WORDS], pa.int64()), "w": pa.array([out.tobytes()], pa.binary())})

    words = (keys.select("h1", "h2").mapInArrow(places, "word bigint, v bigint").groupBy("word").agg(F.expr("bit_or(v)").alias("v"))
             .withColumn("block", F.expr(f"word div {BLOCK_WORDS}")))
    out = np.zeros(-(-bits // 64 // BLOCK_WORDS) * BLOCK_WORDS, _U)
    for r in words.groupBy("block").applyInArrow(lambda t: block(t), "block bigint, w binary").collect():  # the filter
        out[r["block"] * BLOCK_WORDS:(r["block"] + 1) * BLOCK_WORDS] = np.frombuffer(r["w"], _U)
    return Level(bits, hashes, out[:bits // 64])


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels of the cascade for the rows of ``listed`` (column key) over ``universe`` (column key).

    Both are sets of distinct keys.  ``universe`` must hold every key that is ever asked; listed keys
    outside it need not be told apart from anything.  The first level's rate follows from the two
    sizes, the later ones take 0.5, as their sets halve each time.
    """
    inside, outside = saved(_hashed(listed)), saved(_hashed(universe.join(listed, "key", "left_anti")))
    n, n_out = inside.count(), outside.count()
    levels: list[Level] = []
    rate = min(0.5, max(1e-9, n / max(1, n_out) / math.sqrt(2)))
    while n:
        salt = len(levels)
        level = _level(inside, n, rate, salt)
        levels.append(level)
        shared = inside.sparkSession.sparkContext.broadcast(level)

        def mistaken(batches: Iterator[pa.RecordBatch], shared=shared, salt=salt) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(passes(shared.value, salt, b.column(1).to_numpy(), b.column(2).to_numpy())))

        # what this level takes in by mistake is what the next one encodes
        wrong = saved(outside.mapInArrow(mistaken, "key string, h1 bigint, h2 bigint"))
        n = wrong.count()
        inside, outside = wrong, inside
        rate = 0.5
    return levels


def is_listed(levels: Sequence[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Membership of keys of the universe: true where an odd number of levels in a row is passed."""
    alive, passed = np.ones(len(h1), bool), np.zeros(len(h1), np.int64)
    for salt, level in enumerate(levels):
        alive &= passes(level, salt, h1, h2)
        passed += alive
    return passed % 2 == 1


@shielded("url")
def filter_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame = RULES, url: str = "url",
                default: str = "allow") -> DataFrame:
    """``pages`` with columns host, path, rule and verdict (existing ones of these names are replaced).

    ``rules`` are ``Rule`` rows or a table (verdict, host, path) of any size.  rule is ``host + path`` of the longest fitting rule
    (ties: the longer host) or null; verdict its verdict or ``default``, block where a rule is in both lists.  A rule fits its host and all
    subdomains if the path starts with its path.  Null urls and urls without ``://`` have empty host and path and fit no rule with a
    path.  Rows, repeated ones too, are kept as they are, and so are other columns, whatever their names; an empty table gives an empty table; no rules: every
    url gets ``default``.
    """
    host, path = url_parts(F.col(url))
    base = pages.withColumns({"host": host, "path": path})
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in dict.fromkeys(rules)], "verdict string, host string, path string")
    rules = rules.where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL")
    # as many as there are different lengths of paths
    lengths = sorted(r["n"] for r in rules.select(F.length("path").alias("n")).distinct().collect())
    if not lengths:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keyed = base.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = saved(keyed.select(F.explode("_keys").alias("key")).distinct())
    named = rules.select("verdict", F.concat("host", F.lit("\0"), "path").alias("key")).distinct()
    shared = [spark.sparkContext.broadcast(build_cascade(named.where(F.col("verdict") == v).select("key"), universe)) for v in ("block", "allow")]
    hashed = keyed.withColumns({"_h1": F.transform("_keys", lambda k: F.xxhash64(k)), "_h2": F.transform("_keys", lambda k: F.xxhash64(k, F.lit(1)))})
    carried = keyed.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, allow = (c.value for c in shared)
        for b in batches:
            lists = b.column(b.num_columns - 1)
            size = np.diff(lists.offsets.to_numpy())
            h1, h2 = (b.column(b.num_columns - i).flatten().to_numpy() for i in (2, 1))
            blocked = is_listed(block, h1, h2)
            hit = np.flatnonzero(blocked | is_listed(allow, h1, h2))
            row = np.repeat(np.arange(len(size)), size)[hit]
            row, first = np.unique(row, return_index=True)  # keys are in order: the first one of a row is the best
            at, verdict = np.full(len(size), -1), np.zeros(len(size), bool)
            at[row] = hit[first] - (np.cumsum(size) - size)[row]
            verdict[row] = blocked[hit[first]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(at.astype(np.int32)), pa.array(verdict)], names=[*carried, "_at", "_blocked"])

    out = hashed.select(*carried, "_h1", "_h2").mapInArrow(judge, schema + ", _at int, _blocked boolean")
    found = F.col("_at") >= 0
    return out.withColumns({
        "rule": F.when(found, F.translate(F.get("_keys", F.col("_at")), "\0", "")),
        "verdict": F.when(~found, F.lit(default)).when(F.col("_blocked"), F.lit("block")).otherwise(F.lit("allow"))}).drop("_keys", "_at", "_blocked")


def _sql() -> str:
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
    return f"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         row_number() OVER () AS rn FROM parts),
rules(verdict, rhost, rpath) AS (VALUES {rules}),
fits AS (
  SELECT s.rn, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY s.rn ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM split s JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON f.rn = s.rn AND f.k = 1"""


@query("op3_url_filter", _sql())
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by ``RULES``."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")
