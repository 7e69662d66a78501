"""Benchmark decontamination by edit distance.

Texts are read as lower-case words with one blank between.  A benchmark item is found in a document
if some stretch of the document is within ``MAX_EDITS`` of the item's length in character edits.

Candidates come from pieces, without loss.  An item that may have k edits is cut into k + 1 pieces: a copy within
the limit holds one of them unchanged.  Every place of every text is looked up, by a rolling hash, among the items'
pieces.  Neighbouring pieces form groups of up to 64 characters; by the same argument some group of g pieces has at
most g - 1 edits and holds an unchanged piece, so a place goes on only if the group around it is that near
(bit-parallel edit distance of many places at once).  What is left is compared exactly with the whole item.

Items under ``SHORT`` characters must stand unchanged, between word borders (scripts that are written without
blanks have none), since edited ones could not be told from chance.

Items go to the tasks in blocks of bounded size; documents are read where they lie, without a shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tastegrid.llm.common import documents, query
from tastegrid.sources.tables import read_table

#: Edits allowed, as a share of the item's characters.
MAX_EDITS = 0.10
#: Shorter items are found as exact copies only.
SHORT = 20
#: Characters of the items that are sent to the tasks at once.
BLOCK_CHARS = 8_000_000
#: Characters of texts and places that are searched at once, candidates compared at once.
TEXT_CHARS, PLACES, CANDIDATES = 1 << 20, 1 << 18, 8_192
#: Characters of a piece that are looked up, and of a group.
PIECE, GROUP = 16, 64
#: Character classes in the comparison of groups (classes that are shared let more through, never less).
CLASSES = 128
#: Room before and behind the texts, so that groups at their borders can be read.
ROOM = 4 * GROUP
MULTIPLIER, SPREAD = 0x9E3779B1, 0x85EBCA6B
_WORD = re.compile(r"[^\W_]+")
#: Letters of scripts without blanks between words: Thai and Lao, Tibetan, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal_words(text: str | None) -> list[str]:
    """Runs of letters and digits, lower case."""
    return _WORD.findall((text or "").lower())


def best_distance(item: str, text: str, limit: int) -> tuple[int, int] | None:
    """(edits, end) of the substring of ``text`` nearest to ``item``, the first of the best; None over ``limit``.

    Bit-parallel dynamic programming: one integer holds a column's differences.
    """
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        at[c] |= 1 << i
    up, down, score, best = full, 0, n, (n, 0)
    for k, c in enumerate(text):
        eq = at.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq | down
        hp = down | ~(d | up) & full
        hn = up & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1 & full, hn << 1 & full
        up, down = hn | ~(x | hp) & full, hp & x
        if score < best[0]:
            best = (score, k + 1)
    return best if best[0] <= limit else None


def piece_hashes(codes: np.ndarray, lengths: Iterable[int]) -> dict[int, np.ndarray]:
    """For each length, the hash of the characters from each place on (places that have so many)."""
    lengths = sorted(lengths)
    spans, powers = [codes.astype(np.uint32)], [MULTIPLIER]  # of 1, 2, 4 ... characters
    while lengths and 2 << len(spans) - 1 <= lengths[-1]:
        step, last = 1 << len(spans) - 1, spans[-1]
        spans.append(last[:max(0, len(last) - step)] * np.uint32(powers[-1]) + last[step:])
        powers.append(powers[-1] ** 2 % (1 << 32))
    out = {}
    for n in lengths:
        places = max(0, len(codes) - n + 1)
        at, key = 0, np.zeros(places, np.uint32)
        for bit in range(len(spans) - 1, -1, -1):
            if n >> bit & 1:
                key = key * np.uint32(powers[bit]) + spans[bit][at:at + places]
                at += 1 << bit
        out[n] = key * np.uint32(SPREAD)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Table(NamedTuple):
    """The pieces of one length."""
    shift: np.uint32
    known: np.ndarray  # by the upper bits of the hash: some piece has them
    keys: np.ndarray  # sorted hashes, one for each piece
    offset: np.ndarray  # where the piece stands in its item
    group: np.ndarray


class Items:
    """The items of a block, as the tasks look them up."""

    def __init__(self, rows: list[tuple[int | None, str | None]], max_edits: float):
        self.items: list[tuple[int | None, str, int]] = []
        groups: list[tuple[int, int, int, int]] = []  # item, first character, characters, edits
        pieces = defaultdict(list)  # length -> (text, offset, group)
        for item_id, text in rows:
            spelled = " ".join(normal_words(text))
            n = len(spelled)
            if not n:
                continue
            limit = min(int(max_edits * n), n - 1) if n >= SHORT else 0
            cuts = [j * n // (limit + 1) for j in range(limit + 2)]
            of_group = -(-(limit + 1) // max(1, GROUP // -(-n // (limit + 1))))
            looked_up = min(PIECE, n // (limit + 1))
            for g in range(of_group):
                first, last = g * (limit + 1) // of_group, (g + 1) * (limit + 1) // of_group
                for j in range(first, last):
                    pieces[looked_up].append((spelled[cuts[j]:cuts[j] + looked_up], cuts[j], len(groups)))
                groups.append((len(self.items), cuts[first], min(GROUP, cuts[last] - cuts[first]), last - first - 1))
            self.items.append((item_id, spelled, limit))
        self.of, self.first, self.size, self.edits = np.array(groups, np.int64).reshape(-1, 4).T
        self.classes = np.zeros((len(groups), GROUP), np.uint8)
        for g, (i, first, size, _) in enumerate(groups):
            self.classes[g, :size] = _codes(self.items[i][1][first:first + size]) % CLASSES
        self.tables: dict[int, Table] = {}
        for n, found in pieces.items():
            keys = piece_hashes(_codes("".join(t for t, _, _ in found)), [n])[n][::n]
            order = np.argsort(keys, kind="stable")
            shift = np.uint32(32 - min(26, max(16, (32 * len(found)).bit_length())))
            known = np.zeros(1 << 32 - int(shift), bool)
            known[keys >> shift] = True
            self.tables[n] = Table(shift, known, keys[order], np.array([o for _, o, _ in found])[order],
                                   np.array([g for _, _, g in found])[order])

    def near(self, codes: np.ndarray, group: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether each group is within its edits of a stretch of ``codes`` around the place where it would start."""
        out = np.zeros(len(group), bool)
        one = np.uint64(1)
        for lo in range(0, len(group), CANDIDATES):
            mine, of = np.unique(group[lo:lo + CANDIDATES], return_inverse=True)
            size, edits = self.size[mine], self.edits[mine]
            equal = np.zeros((len(mine), CLASSES), np.uint64)
            for j in range(int(size.max())):
                has = np.flatnonzero(size > j)
                equal[has, self.classes[mine[has], j]] |= one << np.uint64(j)
            equal, row = equal.reshape(-1), of * CLASSES
            top = (size - 1).astype(np.uint64)[of]
            at = start[lo:lo + CANDIDATES] - edits[of]
            up, down = np.full(len(of), ~np.uint64(0)), np.zeros(len(of), np.uint64)
            score = size[of].astype(np.int64)
            best = score.copy()
            for j in range(int((size + 2 * edits).max())):
                eq = equal[row + codes[at + j] % CLASSES]
                x = eq | down
                d = (((eq & up) + up) ^ up) | x
                hp, hn = down | ~(d | up), up & d
                score += (hp >> top & one).astype(np.int64)
                score -= (hn >> top & one).astype(np.int64)
                hp, hn = hp << one, hn << one
                up, down = hn | ~(x | hp), hp & x
                np.minimum(best, score, out=best)
            out[lo:lo + CANDIDATES] = best <= edits[of]
        return out

    def candidates(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """Sorted (text, item, place where the item would start): near every copy within the limit there is one."""
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        codes = np.zeros(int(begin[-1]) + 2 * ROOM, np.uint32)
        codes[ROOM:ROOM + int(begin[-1])] = _codes("".join(t + "\0" for t in texts))
        out: set[tuple[int, int, int]] = set()
        longest = max(self.tables)
        for lo in range(0, int(begin[-1]), PLACES):
            hashes = piece_hashes(codes[ROOM + lo:ROOM + min(int(begin[-1]), lo + PLACES + longest - 1)], self.tables)
            for n, table in self.tables.items():
                key = hashes[n][:PLACES]
                at = np.flatnonzero(table.known[key >> table.shift])
                a = np.searchsorted(table.keys, key[at])
                count = np.searchsorted(table.keys, key[at], side="right") - a
                piece = np.arange(count.sum()) + np.repeat(a - (np.cumsum(count) - count), count)
                place = np.repeat(at, count) + lo
                group, text = table.group[piece], np.searchsorted(begin, place, side="right") - 1
                start = place - table.offset[piece]
                # pieces of a group that stand in their places count once
                order = np.lexsort((start, text, group))
                group, text, start = group[order], text[order], start[order]
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(group) != 0) | (np.diff(text) != 0) | (np.diff(start) != 0)
                group, text, start = group[new], text[new], start[new]
                ok = self.near(codes, group, start + self.first[group] + ROOM)
                out.update(zip(text[ok].tolist(), self.of[group[ok]].tolist(), (start - begin[text])[ok].tolist(), strict=True))
        return sorted(out)


def _at_borders(item: str, text: str, start: int) -> bool:
    """Whether the item stands unchanged at this place of the text, between word borders."""
    end = start + len(item)
    return (start >= 0 and text.startswith(item, start)
            and (start == 0 or text[start - 1] == " " or bool(_UNSPACED.match(item[0])))
            and (end == len(text) or text[end] == " " or bool(_UNSPACED.match(item[-1]))))


def _best(item: str, limit: int, text: str, starts: list[int]) -> tuple[int, int] | None:
    """(edits, first character) of the text's best stretch around the sorted places; the first of the best."""
    if len(item) < SHORT:
        return next(((0, s) for s in starts if _at_borders(item, text, s)), None)
    around: list[list[int]] = []
    for s in starts:
        lo, hi = max(0, s - limit), s + len(item) + limit
        if around and lo <= around[-1][1]:
            around[-1][1] = hi
        else:
            around.append([lo, hi])
    best = None
    for lo, hi in around:
        hit = best_distance(item, text[lo:hi], limit)
        if hit and (best is None or hit[0] < best[0]):
            back = best_distance(item[::-1], text[lo:lo + hit[1]][::-1], hit[0])
            best = hit[0], lo + hit[1] - back[1]
    return best


def _found(items: Items, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, edits, first word, length in characters), the best place of each item in each text."""
    spelled: list[str] = []
    size = first = 0
    for t, text in enumerate(texts):
        spelled.append(" ".join(normal_words(text)))
        size += len(spelled[-1])
        if size < TEXT_CHARS and t + 1 < len(texts):
            continue
        for (k, i), places in groupby(items.candidates(spelled), key=lambda c: c[:2]):
            _, item, limit = items.items[i]
            hit = _best(item, limit, spelled[k], [c[2] for c in places])
            if hit:
                yield first + k, i, hit[0], spelled[k].count(" ", 0, hit[1]), len(item)
        spelled, size, first = [], 0, t + 1


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of at most about ``BLOCK_CHARS`` characters."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = 1 + int(total) // BLOCK_CHARS
    for b in range(blocks):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()]


def find_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text", max_edits: float = MAX_EDITS) -> DataFrame:
    """Rows (doc_id, item_id, edits, first_word, item_chars), one for each item found in a document.

    edits is the least number of character edits, first_word the word of the document in which the
    best place starts (of equals the first).  Null and empty texts hold nothing; null items and those
    without a letter or digit are found nowhere, items under ``SHORT`` characters only as exact copies between word borders.  Repeated rows of either
    table give one result; documents that share an id are one document; null ids are kept as null.  An empty table
    on either side gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, edits int, first_word int, item_chars int"
    out = None
    for block in _blocks(benchmark, item_id, item_text):
        items = Items(sorted(set(block), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), max_edits)
        if not items.items:
            continue
        shared = spark.sparkContext.broadcast(items)  # at most BLOCK_CHARS characters of items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for b in batches:
                ids = b.column(0).to_pylist()
                got = list(_found(known, b.column(1).to_pylist()))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([ids[g[0]] for g in got], pa.int64()),
                    "item_id": pa.array([known.items[g[1]][0] for g in got], pa.int64()),
                    "edits": pa.array([g[2] for g in got], pa.int32()),
                    "first_word": pa.array([g[3] for g in got], pa.int32()),
                    "item_chars": pa.array([g[4] for g in got], pa.int32())})

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.min(F.struct("edits", "first_word", "item_chars")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", max_edits: float = MAX_EDITS) -> DataFrame:
    """``docs`` without the rows in which some item is found; each row is judged by itself, without a shuffle.

    Null and empty texts stay, repeated rows go or stay together, and an empty benchmark drops nothing.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text)
    for block in _blocks(benchmark, item_id, item_text):
        items = Items(sorted(set(block), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), max_edits)
        if not items.items:
            continue
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[g[0] for g in _found(shared.value, b.column(at).to_pylist())]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


@query("op7_decontaminate")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items found in all documents."""
    return find_items(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
