"""Main text of web pages.

Markup names the article of most pages: text inside ``article`` (else ``main``) without the parts
that are none of it (menus, headers, footers, sidebars, notices, adverts, forms, comments ...).

Pages without such text are told from their host's boilerplate by suffix arrays.  The token
streams of all pages of a host, as far as they lie outside articles, are put together; token runs that
are found on distinct pages (pages with equal html count once) are boilerplate, and what is left of
the page's blocks, its unique runs, is the text (with articles that only class names of wrappers exclude).  A host's pages are dealt into shards of bounded size, each
sorted in one task by prefix doubling over token numbers; the shards that hold a window are then counted
by an aggregate, so a run is found wherever its pages lie, and a host with a third of all pages is no single task.

Articles go through the arrays too, for what stands unmarked in them (calls to subscribe, share lines, notices).  There a run
is taken away by its place only: a whole block (of ``RUN_TOKENS`` tokens or more) of which every window stands in
more of the host's distinct articles than the article's median window does.  So copies and near-copies of an
article, whose windows all stand in several, keep their text, and so do passages within a block.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tastegrid.llm.common import query, saved, shielded, text_or_empty
from tastegrid.llm.url_filter import url_parts
from tastegrid.sources.tables import read_table

#: Tokens that a run must have to be boilerplate, and pages in a shard (in the mean).
RUN_TOKENS, SHARD_PAGES = 6, 2_048
#: Parts (16 at least, a power of 2) in which the windows of a host with several shards are counted.
BUCKETS = 16
#: Stands RUN_TOKENS - 1 times behind each block of a stream.
END = "\0"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q ruby rb rp rt s "
                   "samp small span strike strong sub sup time tt u var wbr img label".split())
#: Elements whose text is not the article's.
OUT_TAGS = frozenset("nav header footer aside form menu dialog button select option svg math canvas audio video object "
                     "template script style head".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
                      "toolbar".split())
#: Words of class names and ids that mark such text.
OUT_WORDS = frozenset("ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies "
                      "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing "
                      "social sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs header footer masthead comment "
                      "comments respond reply replies disqus related recommended recommendations widget widgets toolbar pagination pager "
                      "copyright disclaimer search".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: First words of class names that tell of a layout, as in has-sidebar; they mark nothing.
LAYOUT = frozenset("has have with no without".split())

_PART = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _is_out(tag: str, attributes: str) -> int:
    """2 if the element or its role excludes its text, 1 if a class name or id does, else 0."""
    if tag in OUT_TAGS:
        return 2
    if not attributes or tag in ("body", "html", "article", "main"):
        return 0
    out = 0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        name = name.lower()
        if name == "role" and value.lower() in OUT_ROLES:
            return 2
        if name in ("class", "id") and not OUT_WORDS.isdisjoint(_PART.findall(_CAMEL.sub(" ", value).lower())):
            for part in value.split():
                words = _PART.findall(_CAMEL.sub(" ", part).lower())
                if words and words[0] not in LAYOUT and not OUT_WORDS.isdisjoint(words):
                    out = 1
    return out


class Block(NamedTuple):
    text: str
    region: str  # "article", "main" or ""
    tagged: bool  # an element or role excludes it
    named: int  # so many elements around it are excluded by class name or id

    @property
    def out(self) -> bool:
        return self.tagged or self.named > 0


def blocks(page: str) -> list[Block]:
    """A page's blocks in order.

    Character references are decoded, white space is one blank, and ends are trimmed; blocks without text are left out.
    """
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    tagged = named = articles = mains = 0

    def end_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                region = "article" if articles else "main" if mains else ""
                out.append(Block(text, region, tagged > 0, named))

    def add(text: str) -> None:
        if text:
            parts.append(html_lib.unescape(text) if "&" in text else text)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is None:
                if tag not in INLINE:
                    end_block()
                continue
            if any(t not in INLINE for t, _ in stack[depth:]):
                end_block()
            for t, gone in stack[depth:]:
                tagged -= gone == 2
                named -= gone == 1
                articles -= t == "article"
                mains -= t == "main"
            del stack[depth:]
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if tag not in INLINE:
            end_block()
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        gone = _is_out(tag, m[3])
        if gone and tag in INLINE:
            end_block()
        if tag == "main" or "main" in m[3] and re.search(r"""role\s*=\s*["']?main\b""", m[3], re.I):
            tag = "main" if tag == "main" else tag
            mains += tag == "main"
        articles += tag == "article"
        tagged += gone == 2
        named += gone == 1
        stack.append((tag, gone))
    end_block()
    return out


def article_blocks(page: str) -> list[str] | None:
    """Blocks of the page's article, else of its main element; None if neither has text that markup leaves in."""
    found = blocks(page)
    for region in ("article", "main"):
        inside = [b.text for b in found if b.region == region and not b.out]
        if inside:
            return inside
    return None


def article_text(page: str) -> str | None:
    """Text of ``article_blocks``."""
    inside = article_blocks(page)
    return None if inside is None else " ".join(inside)


def _tokens(text: str) -> list[str]:
    """Tokens of a block with its end."""
    return text.split() + [END] * (RUN_TOKENS - 1)


def _packed(texts: list[str]) -> tuple[bytes, int, int]:
    """The blocks of an article compressed, how long they are otherwise, and their hash; blocks have no line ends."""
    whole = "\n".join(texts).encode("utf-8", "surrogatepass")
    return (pa.compress(whole, codec="zstd", asbytes=True), len(whole), int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little", signed=True))


def _unpacked(table: pa.Table) -> pa.ListArray:
    """The blocks of each row's ``_packed`` article."""
    return pa.array([pa.decompress(a, size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\n")
                     for a, size in zip(table.column("_art").to_pylist(), table.column("_size").to_pylist(), strict=True)], pa.list_(pa.string()))


def _ranks(rank: np.ndarray) -> np.ndarray:
    """The rank of the window of ``RUN_TOKENS`` token numbers at each place, by prefix doubling."""
    have = 1
    while have < RUN_TOKENS:  # the last doubling overlaps, so that exactly RUN_TOKENS tokens count
        step = min(have, RUN_TOKENS - have)
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:]
        rank = np.unique(rank << 32 | ahead, return_inverse=True)[1]
        have += step
    return rank


class ArticleWindows:
    """Suffix array over the articles of one shard, cut where blocks end.

    ``inside`` has the blocks of each page, null for pages without an article.  Equal articles are one.
    """

    def __init__(self, inside: pa.ListArray):
        known = inside.filter(pc.is_valid(inside))
        whole = pc.binary_join(known, "\n").dictionary_encode()
        self.of_page = whole.indices.to_numpy().astype(np.int64)
        first = np.unique(self.of_page, return_index=True)[1]
        known = known.take(pa.array(first))
        words = pc.split_pattern(known.flatten(), " ")
        tokens = words.flatten().dictionary_encode()
        self.n_articles, self.block_article = len(known), np.repeat(np.arange(len(known)), pc.list_value_length(known).to_numpy())
        size = pc.list_value_length(words).to_numpy().astype(np.int64)
        self.n_blocks = np.bincount(self.block_article, minlength=self.n_articles)
        ids = tokens.indices.to_numpy().astype(np.int64)
        # windows are those that a block holds whole
        start = np.cumsum(size) - size
        place = np.arange(len(ids)) - np.repeat(start, size)
        self.at = np.flatnonzero(place + RUN_TOKENS <= np.repeat(size, size))
        self.block = np.repeat(np.arange(len(size)), size)[self.at]
        self.article = self.block_article[self.block]
        rank = _ranks(ids)[self.at] if len(self.at) else self.at
        order = np.lexsort((self.article, rank))
        new = np.diff(rank[order], prepend=-1) != 0
        other = new | (np.diff(self.article[order], prepend=-1) != 0)
        group = np.cumsum(new) - 1
        count = np.bincount(group[other], minlength=int(group[-1]) + 1 if len(group) else 0)
        #: number of each window among the distinct ones, and how many articles of the shard hold each of these
        self.window = np.empty(len(order), np.int64)
        self.window[order] = group
        self.count, self.spot = count, self.at[order[new]]
        self._ids, self._tokens = ids, tokens.dictionary

    def hashes(self) -> np.ndarray:
        """A 60-bit hash of the text of each distinct window, the same in every shard."""
        word = pd.util.hash_array(self._tokens.to_numpy(zero_copy_only=False), categorize=False)[self._ids]
        out = np.zeros(len(self.spot), np.uint64)
        for k in range(RUN_TOKENS):
            out = (out ^ word[self.spot + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return (out >> np.uint64(4)).view(np.int64)

    def dropped(self, more: np.ndarray) -> list[np.ndarray]:
        """For each page with an article the blocks that are boilerplate; ``more`` are articles of other shards that hold each distinct window."""
        found = (self.count + more)[self.window]
        order = np.lexsort((found, self.article))
        n = np.bincount(self.article, minlength=self.n_articles)
        median = np.full(self.n_articles, np.iinfo(np.int64).max)
        some = np.flatnonzero(n)
        median[some] = found[order][(np.cumsum(n) - n)[some] + (n[some] - 1) // 2]
        gone = np.bincount(self.block, minlength=len(self.block_article)) > 0
        gone[self.block[found <= median[self.article]]] = False
        per = np.split(gone, np.cumsum(self.n_blocks)[:-1])
        return [per[a] for a in self.of_page]


def shard_windows(streams: list[list[str]], pages: list[int]) -> tuple[list[np.ndarray], dict, list[str]]:
    """Suffix array over the streams of one shard.

    Returns for each stream whether the window of ``RUN_TOKENS`` tokens at each token is found on another
    page too, {window text: [(stream, place), ...]} of the windows of a single page, and the texts of the windows of
    several pages.  ``pages`` numbers the distinct pages.  Windows do not cross blocks, but a block shorter than a window is one with its end.
    """
    number: dict[str, int] = {}
    ids, of, place = [], [], []
    for k, tokens in enumerate(streams):
        ids += [number.setdefault(t, len(number) + 1) for t in tokens] + [0]
        of += [k] * (len(tokens) + 1)
        place += range(len(tokens) + 1)
    repeated = [np.zeros(max(0, len(s) - RUN_TOKENS + 1), bool) for s in streams]
    if not any(len(r) for r in repeated):
        return repeated, {}, []
    of_, place_ = np.array(of), np.array(place)
    rank = _ranks(np.array(ids, np.int64))
    lengths = np.array([len(s) for s in streams])
    end = np.isin(ids, [0, number.get(END, 0)])
    inside = np.ones(len(end), bool)
    for k in range(RUN_TOKENS):
        inside[:len(end) - k] &= ~end[k:]
    at = np.flatnonzero((place_ + RUN_TOKENS <= lengths[of_]) & ~end & (inside | np.append(True, end[:-1])))
    order = at[np.argsort(rank[at], kind="stable")]  # the suffix array, ties in text order
    first = np.append(np.flatnonzero(np.diff(rank[order], prepend=-1)), len(order))
    page = np.array(pages)[of_]
    alone: dict = {}
    several: list[str] = []
    for a, b in zip(first, first[1:], strict=False):
        group = order[a:b]
        s, p = of_[group[0]], place_[group[0]]
        window = " ".join(streams[s][p:p + RUN_TOKENS])
        if (page[group] != page[group[0]]).any():
            several.append(window)
            for s, p in zip(of_[group].tolist(), place_[group].tolist(), strict=True):
                repeated[s][p] = True
        else:
            alone[window] = list(zip(of_[group].tolist(), place_[group].tolist(), strict=True))
    return repeated, alone, several


def _boilerplate(streams: DataFrame) -> DataFrame:
    """Rows (host, version, starts): where windows start that distinct pages of the host share.

    ``streams`` has (host, version, tokens), one row for each distinct page of a host.
    """
    sizes = streams.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    shards = F.ceil(F.col("pages") / SHARD_PAGES)
    dealt = streams.join(sizes, "host").withColumn("shard", F.pmod(F.xxhash64("version"), shards)).drop("pages")

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = [list(t) for t in pdf["tokens"]]
        repeated, alone, several = shard_windows(tokens, pd.factorize(pdf["version"])[0].tolist())
        rows = [(pdf["host"].iloc[0], v, np.flatnonzero(r).tolist(), None) for v, r in zip(pdf["version"], repeated, strict=True)]
        for window, spots in alone.items():
            rows.append((pdf["host"].iloc[0], pdf["version"].iloc[spots[0][0]], [p for _, p in spots], window))
        # their places are known, but pages of other shards may hold them once
        rows += [(pdf["host"].iloc[0], 0, None, window) for window in several]
        return pd.DataFrame(rows, columns=["host", "version", "starts", "window"])

    found = saved(dealt.groupBy("host", "shard").applyInPandas(
        sort, "host string, version bigint, starts array<int>, window string"))
    single = found.where("window IS NOT NULL AND starts IS NOT NULL")
    # one row for each shard that holds a window
    shared = (found.where("window IS NOT NULL").groupBy("host", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("host", "window"))
    more = single.join(shared, ["host", "window"], "left_semi")
    return (found.where("window IS NULL").select("host", "version", F.explode("starts").alias("start"))
            .union(more.select("host", "version", F.explode("starts")))
            .groupBy("host", "version").agg(F.collect_set("start").alias("starts")))


@shielded("html", "url")
def extract(pages: DataFrame, html: str = "html", url: str = "url", into: str = "text", drop_html: bool = False) -> DataFrame:
    """``pages`` with the main text in column ``into`` (string, empty if there is none) and n_chars (long).

    Null and empty html have no text.  Null urls and urls without ``://`` share the empty host.  Every row stays,
    repeated ones too, and gets the same text as its equals; other columns are carried, whatever their names (those of the two names
    are replaced); ``drop_html`` leaves the html out.  An empty table gives an empty table.
    """
    names = [c for c in pages.columns if c not in (into, "n_chars") and not (drop_html and c == html)]
    page = text_or_empty(html)
    base = pages.withColumns({"_html": page, "_host": F.coalesce(url_parts(F.col(url).cast("string"))[0], F.lit(""))})
    base = base.select(*names, "_html", "_host").withColumn("_version", F.xxhash64("_html"))
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in base.schema.fields)
    at = len(names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                whole = part.column(at).to_pylist()
                inside = [article_blocks(t) for t in whole]
                # only a page without an article is read again; built anew, as if_else breaks the offsets of a sliced column
                left = pa.array([w if t is None else None for w, t in zip(whole, inside, strict=True)], pa.string())
                packed = [(None, None, v) if t is None else _packed(t) for t, v in zip(inside, part.column(at + 2).to_pylist(), strict=True)]
                art, size, version = (pa.array(c, kind) for c, kind in zip(zip(*packed, strict=True), (pa.binary(), pa.int32(), pa.int64()), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns[:at], left, part.column(at + 1), version, art, size], names=[*part.schema.names, "_art", "_size"])

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [[w for k in blocks(x.as_py()) if not k.region for w in _tokens(k.text)] for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens, pa.list_(pa.string()))],
                                             names=["host", "version", "tokens"])

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [unique_runs(t.as_py(), s) for t, s in zip(b.column(at), b.column(at + 3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, pa.string())], names=[*names, "_text"])

    def texts(table: pa.Table, others: pa.Table) -> pa.Table:
        inside = _unpacked(table)
        arrays = ArticleWindows(inside)
        more = np.zeros(len(arrays.count), np.int64)
        if others.num_rows:
            hashes, counts = (np.concatenate([np.frombuffer(x, "<i8") for x in others.column(c).to_pylist()]) for c in ("hashes", "more"))
            order = np.argsort(hashes)
            mine = arrays.hashes()
            spot = np.minimum(np.searchsorted(hashes, mine, sorter=order), len(order) - 1)
            more = np.where(hashes[order[spot]] == mine, counts[order[spot]], 0)
        out = [" ".join(t for t, g in zip(page, gone, strict=True) if not g) if gone.any() else " ".join(page)
               for page, gone in zip(inside.to_pylist(), arrays.dropped(more), strict=True)]
        return table.select(list(range(at))).append_column("_text", pa.array(out, pa.string()))

    # kept: pages are parsed once, and those of a shard lie together; equal articles fall into one shard
    parsed = base.mapInArrow(read, schema + ", _art binary, _size int")
    large = (base.groupBy("_host").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SHARD_PAGES)
             .select("_host", F.ceil(F.col("_n") / SHARD_PAGES).cast("int").alias("_shards")))
    # at most one row for each SHARD_PAGES pages
    dealt = (parsed.join(F.broadcast(large), "_host", "left").select(*parsed.columns, "_shards")
             .withColumn("_shard", F.pmod(F.xxhash64("_version"), F.coalesce("_shards", F.lit(1))).cast("int"))
             .repartition("_host", "_shard").persist(StorageLevel.MEMORY_AND_DISK))
    marked, rest = dealt.where("_art IS NOT NULL"), dealt.where("_art IS NULL").drop("_art", "_size", "_shards", "_shard")
    others = _in_other_shards(marked.where("_shards IS NOT NULL").select("_host", "_shard", "_art", "_size"))
    result = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in base.schema.fields[:at]), "_text string"])
    out = (marked.drop("_html", "_version", "_shards").groupBy("_host", "_shard").cogroup(others.groupBy("_host", "_shard")).applyInArrow(texts, result))
    if not rest.isEmpty():
        # what lies outside articles, of all pages
        streams = (base.select("_host", "_version", "_html").mapInArrow(loose, "host string, version bigint, tokens array<string>")
                   .where(F.size("tokens") > 0).dropDuplicates(["host", "version"]))
        found = _boilerplate(saved(streams))
        joined = rest.join(found, (rest["_host"] == found["host"]) & (rest["_version"] == found["version"]), "left")
        joined = joined.select(*names, "_html", "_host", "_version", "starts")
        out = out.union(joined.mapInArrow(unique, result))
    return out.select(*names, F.col("_text").alias(into), F.length("_text").cast("long").alias("n_chars"))


def _in_other_shards(articles: DataFrame) -> DataFrame:
    """Rows (_host, _shard, hashes, more): windows of a shard's articles that articles of the host's other shards hold, and how many do.

    ``articles`` has (_host, _shard, _art, _size) of hosts with several shards.
    """
    def windows(table: pa.Table) -> pa.Table:
        arrays = ArticleWindows(_unpacked(table))
        hashes = arrays.hashes()
        bucket = hashes & (BUCKETS - 1)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(1, BUCKETS))
        return pa.table({"_host": [table.column("_host")[0].as_py()] * BUCKETS, "_shard": pa.array([table.column("_shard")[0].as_py()] * BUCKETS, pa.int32()),
                         "bucket": pa.array(range(BUCKETS), pa.int32()),
                         # what the bucket does not tell: seven bytes
                         "hashes": [np.ascontiguousarray((hashes[i] // BUCKETS).view(np.uint8).reshape(-1, 8)[:, :7]).tobytes() for i in np.split(order, cuts)],
                         "n": pa.array([arrays.count[i].astype("<i4").tobytes() for i in np.split(order, cuts)], pa.binary())})

    def merged(table: pa.Table) -> pa.Table:
        def whole(packed: bytes) -> np.ndarray:
            out = np.zeros((len(packed) // 7, 8), np.uint8)
            out[:, :7] = np.frombuffer(packed, np.uint8).reshape(-1, 7)
            return out.view("<i8").ravel() * BUCKETS + table.column("bucket")[0].as_py()

        parts = [(whole(h), np.frombuffer(n, "<i4")) for h, n in zip(table.column("hashes").to_pylist(), table.column("n").to_pylist(), strict=True)]
        every, place = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([n for _, n in parts]), minlength=len(every)).astype(np.int64)
        rows, lo = [], 0
        for h, n in parts:
            more = total[place[lo:lo + len(h)]] - n
            lo += len(h)
            rows.append((h[more > 0].tobytes(), more[more > 0].astype("<i8").tobytes()))
        return pa.table({"_host": table.column("_host"), "_shard": table.column("_shard"),
                         "hashes": pa.array([h for h, _ in rows], pa.binary()), "more": pa.array([m for _, m in rows], pa.binary())})

    each = articles.groupBy("_host", "_shard").applyInArrow(windows, "_host string, _shard int, bucket int, hashes binary, n binary")
    return (each.groupBy("_host", "bucket").applyInArrow(merged, "_host string, _shard int, hashes binary, more binary")
            .where(F.length("hashes") > 0))


def unique_runs(page: str, starts: list[int] | None) -> str:
    """Text of a page for which ``article_text`` has none.

    It is what lies outside articles and is not excluded, without the repeated windows.  Text of articles that
    only class names exclude (the fewest of them) goes along whole, unless it is less than the text outside,
    as with teasers and comments.  If there is nothing of both, class names exclude nothing but what has more of them.
    """
    found = blocks(page)
    left = [b for b in found if not b.tagged]
    fewest = min((b.named for b in left if b.region), default=0)
    inside = {b for b in left if b.region and b.named == fewest}
    outside = {b for b in left if not b.region and not b.named}
    if sum(len(b.text) for b in inside) < sum(len(b.text) for b in outside):
        inside = set()
    if not inside and not outside:
        fewest = min((b.named for b in left), default=0)
        outside = {b for b in left if b.named == fewest}
    gone = np.zeros(sum(len(_tokens(b.text)) for b in found if not b.region) + RUN_TOKENS, bool)
    for s in starts or ():
        gone[s:s + RUN_TOKENS] = True
    kept, at = [], 0
    for b in found:
        if b.region:
            if b in inside:
                kept.append(b.text)
            continue
        words = b.text.split()
        if b in outside:
            kept += [w for i, w in enumerate(words) if not gone[at + i]]
        at += len(words) + RUN_TOKENS - 1
    return " ".join(kept)


@query("op1_html_extract")
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), drop_html=True)
