"""Blocked user x item scoring with per-user top-k.

Scoring every user against every item is the one place where the work is a
product.  It is never materialised as rows:

* users are hashed into U blocks and items into B blocks (a grid over blocks,
  not a cross join of rows): a user row is replicated to the B item blocks and
  an item row to the U user blocks;
* the user's excluded (seen) pairs travel on the user side, keyed by the
  *item's* block, so even a user owning a third of all history is spread
  over B groups;
* a (user block, item block) pair is one partition: its items are held, its users stream by and are scored with
  NumPy in bounded chunks; only that block's top-k per user is emitted;
* a window keeps the global top-k per user out of at most B * k rows.

Hybrid candidates (H5) take two passes over the grid, whatever the catalogue's
size.  The first emits, per user and item block, the best CF and content scores
alone; their merge over the blocks gives each user the score that the last
candidate of each gate has, and how many items with just that score each block
may still take (blocks are ranges of business_id, so ties go to the lower id).
The second pass blends the items that pass a gate and emits the block's top-k.
A catalogue of one block needs the second pass alone, which finds the gates itself.

Few cells of a block can pass a gate or be in a top-k.  A probe of the block's columns
gives each user a floor; factors are compared with it tile by tile, terms by groups of
similar items, whose largest weights bound the products of all of them.  Only cells over the
floor are scored, rounded and ordered.  Users whose floor leaves too few cells, or too many (very many equal scores),
are scored on all cells.

Ties are broken the same way everywhere: score rounded to 6 decimals
descending, then business_id ascending.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tastegrid.operators.ranking import top_k_per_user
from tastegrid.session import cut_lineage

ITEMS_PER_BLOCK = 20_000        # dense factor block: 20k x 64 doubles ~ 10 MB
USERS_PER_BLOCK = 100_000       # rows on disk: a task holds a chunk of them
MIN_USERS_PER_BLOCK = 64
FACTOR_BLOCKS = 4               # rows with factors alone are small: blocks of so many times the rows, for fewer copies of each
TERM_BLOCKS = 12                # the same where users bring profiles, which are much larger than items
TILE = 20_000                   # columns of a block that are compared at once
GROUP = 16                      # similar items that share one bound
PACKED_TERMS = 256              # terms of an item kept in fixed width
FAST_SHARE = 16                 # blocks of at least so many items for each one asked for find floors
CHUNK_USERS = 2_000             # users of a block in memory at a time, with their pairs
SCORED_BLOCKS = 4               # blocks of so many times the items where all of them are scored
PROBE_SHARE = 32                # a block's columns that set a user's first bound: one in so many
DENSE_CHUNK = 256               # users scored at once: 256 x 20k doubles ~ 40 MB
SPARSE_PAIR_CHUNK = 4_000_000   # term matches expanded at once
CHUNK_CELLS = 4_000_000         # users x items cells scored at once
DENSE_TERM_CELLS = 40_000_000   # items x local vocabulary kept dense (320 MB) before falling back to sparse

OUT_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("business_id", T.StringType()),
    T.StructField("score", T.DoubleType()),
    # components of the score for the emitted rows (null when the mode has none)
    T.StructField("content_score", T.DoubleType()),
    T.StructField("cf_pred", T.DoubleType()),
])


@dataclass(frozen=True)
class ScoreSpec:
    """What to score.

    mode: "cf" (C4: known items; unknown user -> mu + b_i), "cf_pair" (C3: unknown
    user or item drops its terms), "content" (M6 cosine), "hybrid" (H6 blend),
    "gates" and "hybrid_gen" (the two passes of H5).
    """
    mode: str
    mu: float = 0.0
    lo: float = 1.0
    hi: float = 5.0
    prior_weight: float = 0.1
    # H5 only: candidate limits, whether the history is left out, what to emit ("topk" or "candidates")
    cf_limit: int = 800
    content_limit: int = 800
    exclude_history: bool = True
    emit: str = "topk"
    # H5 where one block holds all items: its gates are found together with the blend
    one_block: bool = False


def _dense(series: pd.Series, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Stack an array column into a matrix; null and empty rows -> zeros, returned with a presence mask."""
    vals = series.to_numpy()
    size = np.fromiter((0 if v is None or isinstance(v, float) else len(v) for v in vals), np.int64, len(vals))
    if width is None:
        width = int(size.max(initial=0))
    out = np.zeros((len(series), width), dtype=np.float64)
    whole = np.flatnonzero((size == width) & (size > 0))
    if len(whole):
        out[whole] = np.concatenate(vals[whole]).reshape(-1, width)
    for i in np.flatnonzero((size != width) & (size > 0)):
        n = min(size[i], width)
        out[i, :n] = vals[i][:n]
    return out, size > 0


def _csr(idx: pd.Series, val: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Concatenate per-row sparse arrays into (indptr, indices, values)."""
    idx_vals = [np.asarray(v, dtype=np.int64) if v is not None and not isinstance(v, float) else np.zeros(0, np.int64)
                for v in idx.to_numpy()]
    val_vals = [np.asarray(v, dtype=np.float64) if v is not None and not isinstance(v, float) else np.zeros(0)
                for v in val.to_numpy()]
    lens = np.array([len(v) for v in idx_vals], dtype=np.int64)
    indptr = np.zeros(len(lens) + 1, dtype=np.int64)
    np.cumsum(lens, out=indptr[1:])
    ind = np.concatenate(idx_vals) if len(idx_vals) else np.zeros(0, np.int64)
    vals = np.concatenate(val_vals) if len(val_vals) else np.zeros(0)
    return indptr, ind, vals


class _ItemTerms:
    """Items of one block as a term-major (CSC) index for sparse dot products.

    When the block's own vocabulary is small, the items are also kept as a
    dense (items x local terms) matrix and dot products become one GEMM.
    """

    def __init__(self, t_idx: pd.Series, t_val: pd.Series):
        indptr, terms, vals = _csr(t_idx, t_val)
        self.csr = (indptr, terms, vals)
        n_items = len(indptr) - 1
        item_of = np.repeat(np.arange(n_items), np.diff(indptr))
        self.dense = None
        local_terms, local_of = np.unique(terms, return_inverse=True)
        if len(local_terms) and n_items * len(local_terms) <= DENSE_TERM_CELLS:
            X = np.zeros((n_items, len(local_terms)))
            X[item_of, local_of] = vals
            self.dense = (local_terms, X)
        order = np.argsort(terms, kind="stable")
        self.terms_sorted = terms[order]
        self.items = item_of[order]
        self.vals = vals[order]
        self.uniq, starts = np.unique(self.terms_sorted, return_index=True)
        self.starts = starts
        self.ends = np.append(starts[1:], len(self.terms_sorted))
        self.n_items = n_items

    def dot(self, indptr: np.ndarray, terms: np.ndarray, vals: np.ndarray) -> np.ndarray:
        """(rows x items) dot products of the given sparse rows with every item."""
        n_rows = len(indptr) - 1
        if self.dense is not None:
            local_terms, X = self.dense
            P = np.zeros((n_rows, len(local_terms)))
            if len(terms):
                pos = np.minimum(np.searchsorted(local_terms, terms), len(local_terms) - 1)
                hit = local_terms[pos] == terms
                rows = np.repeat(np.arange(n_rows), np.diff(indptr))
                np.add.at(P, (rows[hit], pos[hit]), vals[hit])
            return P @ X.T
        out = np.zeros(n_rows * self.n_items, dtype=np.float64)
        if len(terms) == 0 or len(self.uniq) == 0:
            return out.reshape(n_rows, self.n_items)
        row_of = np.repeat(np.arange(n_rows), np.diff(indptr))
        pos = np.searchsorted(self.uniq, terms)
        pos_c = np.minimum(pos, len(self.uniq) - 1)
        hit = self.uniq[pos_c] == terms
        row_of, pos_c, pv = row_of[hit], pos_c[hit], vals[hit]
        counts = self.ends[pos_c] - self.starts[pos_c]
        # Expand term matches in bounded slices.
        cum = np.cumsum(counts)
        start = 0
        while start < len(counts):
            base = cum[start - 1] if start else 0
            stop = int(np.searchsorted(cum, base + SPARSE_PAIR_CHUNK, side="right"))
            stop = max(stop, start + 1)
            c = counts[start:stop]
            tot = int(c.sum())
            if tot:
                offs = np.arange(tot) - np.repeat(np.cumsum(c) - c, c) + np.repeat(self.starts[pos_c[start:stop]], c)
                rows = np.repeat(row_of[start:stop], c)
                w = np.repeat(pv[start:stop], c) * self.vals[offs]
                out += np.bincount(rows * self.n_items + self.items[offs], weights=w, minlength=out.size)
            start = stop
        return out.reshape(n_rows, self.n_items)


def _pair_dots(profile: tuple, item_csr: tuple, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Dot product of profile ``rows[i]`` with item ``cols[i]`` for each listed pair (work: the items' terms)."""
    p_ptr, p_terms, p_vals = profile
    ptr, terms, vals = item_csr
    count = ptr[cols + 1] - ptr[cols]
    total = int(count.sum())
    out = np.zeros(len(rows))
    if not total or not len(p_terms):
        return out
    span = int(max(terms.max(), p_terms.max())) + 1
    keys = np.repeat(np.arange(len(p_ptr) - 1), np.diff(p_ptr)) * span + p_terms
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], p_vals[order]
    at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ptr[cols], count)
    want = np.repeat(rows, count) * span + terms[at]
    spot = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    hit = np.where(keys[spot] == want, weights[spot] * vals[at], 0.0)
    return np.bincount(np.repeat(np.arange(len(rows)), count), weights=hit, minlength=len(rows))


def _top_k_select(S: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k largest finite entries; ties go to the lower column (= lower id)."""
    n_rows, n_cols = S.shape
    kk = min(k, n_cols)
    if kk <= 0 or n_rows == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if kk < n_cols:
        t = -np.partition(-S, kk - 1, axis=1)[:, kk - 1]
    else:
        t = np.min(S, axis=1)
    gt = S > t[:, None]
    eq = S == t[:, None]
    need = kk - gt.sum(axis=1)
    take = gt | (eq & (np.cumsum(eq, axis=1) <= need[:, None]))
    take &= np.isfinite(S)
    return np.nonzero(take)


def _best(S: np.ndarray, k: int) -> list[bytes]:
    """Per row the k largest finite values, in falling order, as bytes."""
    k = min(k, S.shape[1])
    if not k:
        return [b""] * len(S)
    top = -np.sort(np.partition(-S, k - 1, axis=1)[:, :k], axis=1) if k < S.shape[1] else -np.sort(-S, axis=1)
    return [row[np.isfinite(row)].tobytes() for row in top]


def _passes(S: np.ndarray, bound: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Cells over their row's bound, and the first ``ties`` cells of each row that equal it."""
    equal = S == bound[:, None]
    return ((S > bound[:, None]) | (equal & (np.cumsum(equal, axis=1) <= ties[:, None]))) & np.isfinite(S)


def _bounds(best: list[np.ndarray], k: int) -> tuple[float, list[int]]:
    """The k-th best value over a user's item blocks, and how many of the values equal to it each block takes."""
    merged = np.sort(np.concatenate(best))[::-1] if best else np.empty(0)
    if len(merged) < k or not k:
        return (-np.inf if k else np.inf), [0] * len(best)
    bound = merged[k - 1]
    left, ties = k - int((merged > bound).sum()), []
    for b in best:
        ties.append(min(left, int((b == bound).sum())))
        left -= ties[-1]
    return float(bound), ties


def _first(r: np.ndarray, c: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first cells of each row: score falling, then the lower column."""
    order = np.lexsort((c, -score, r))
    start = np.flatnonzero(np.diff(r[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) < k]


def _floor(S: np.ndarray, k: int) -> np.ndarray:
    """Per row a score that about k cells or more of the whole block should reach, from the probed columns ``S``."""
    share = k / PROBE_SHARE
    place = math.ceil(share + 4 * math.sqrt(share) + 4)
    if not k or place > S.shape[1]:
        return np.full(len(S), -np.inf)
    return -np.partition(-S, place - 1, axis=1)[:, place - 1]


def _outside(r: np.ndarray, c: np.ndarray, n: int, pairs: tuple) -> np.ndarray:
    """Which cells are none of the pairs (row, column)."""
    if not len(pairs[0]):
        return np.ones(len(r), dtype=bool)
    return ~np.isin(r * n + c, pairs[0] * n + pairs[1])


class _GroupedTerms:
    """Items of one block in groups of similar ones: each group's largest weight of every term bounds its items' products
    with a profile that has no weight below 0."""

    def __init__(self, ptr: np.ndarray, terms: np.ndarray, vals: np.ndarray):
        self.n = n = len(ptr) - 1
        count = np.diff(ptr)
        self.local, at = np.unique(terms, return_inverse=True)
        self.width = len(self.local)
        item_of = np.repeat(np.arange(n), count)
        order = np.lexsort((-vals, item_of))
        place = np.arange(len(terms)) - np.repeat(ptr[:-1], count)
        # terms of an item by falling weight; the place beyond all terms stands for none
        by_weight = np.full((n, int(count.max(initial=0))), self.width, dtype=np.int32)
        weights = np.zeros(by_weight.shape)
        by_weight[item_of, place], weights[item_of, place] = at[order], vals[order]
        self.perm = np.lexsort(by_weight[:, :8].T[::-1]) if by_weight.shape[1] else np.arange(n)
        self.place = np.empty(n, dtype=np.int64)
        self.place[self.perm] = np.arange(n)
        # kept in the order of the groups
        self.terms, self.vals = by_weight[self.perm], weights[self.perm]
        self.most = np.zeros((-(-n // GROUP), self.width))
        np.maximum.at(self.most, (self.place[item_of] // GROUP, at), vals)
        self.kept = None

    @staticmethod
    def fits(ptr: np.ndarray, terms: np.ndarray) -> bool:
        n = len(ptr) - 1
        return (n // min(GROUP, PROBE_SHARE) * len(np.unique(terms)) <= DENSE_TERM_CELLS and np.diff(ptr).max(initial=0) <= PACKED_TERMS)

    def profiles(self, indptr: np.ndarray, terms: np.ndarray, vals: np.ndarray) -> np.ndarray:
        """(rows x block terms + 1) profiles of unit length; the last column is 0."""
        rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
        norms = np.sqrt(np.bincount(rows, weights=vals * vals, minlength=len(indptr) - 1))
        P = np.zeros((len(indptr) - 1, self.width + 1))
        if self.width and len(terms):
            at = np.minimum(np.searchsorted(self.local, terms), self.width - 1)
            hit = self.local[at] == terms
            np.add.at(P, (rows[hit], at[hit]), vals[hit])
        return P / np.where(norms > 0, norms, 1.0)[:, None]

    def cells(self, P: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Products of row r[i] with item c[i]."""
        return self._placed(P, r, self.place[c])

    def _placed(self, P: np.ndarray, r: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(r))
        flat, base = P.ravel(), (r * P.shape[1])[:, None]
        for a in range(0, len(r), TILE):
            some = at[a:a + TILE]
            out[a:a + TILE] = np.einsum("ij,ij->i", flat[base[a:a + TILE] + self.terms[some]], self.vals[some])
        return out

    def _dense(self, at: np.ndarray) -> np.ndarray:
        X = np.zeros((len(at), self.width + 1))
        np.add.at(X, (np.arange(len(at))[:, None], self.terms[at]), self.vals[at])
        return X[:, :-1]

    def columns(self, P: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """(rows x cols) products."""
        return P[:, :-1] @ self._dense(self.place[cols]).T

    def _tiles(self):
        """(first place, dense items) of the block, tile by tile; kept where the block is small enough."""
        if self.kept is not None:
            return self.kept
        each = max(1, min(TILE, DENSE_TERM_CELLS // max(1, self.width)))
        tiles = ((t, self._dense(np.arange(t, min(t + each, self.n)))) for t in range(0, self.n, each))
        if self.n * self.width > DENSE_TERM_CELLS:
            return tiles
        self.kept = list(tiles)
        return self.kept

    def whole(self, P: np.ndarray) -> np.ndarray:
        """(rows x items) products."""
        out = np.zeros((len(P), self.n))
        for t, X in self._tiles():
            out[:, self.perm[t:t + len(X)]] = P[:, :-1] @ X.T
        return out

    def over(self, P: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, columns, products) of the cells over their row's floor, and which rows have too many of them."""
        can = P[:, :-1] @ self.most.T >= floor[:, None]
        wide = np.flatnonzero(can.sum(axis=1) > can.shape[1] // GROUP)
        can[wide] = False
        r, g = np.nonzero(can)
        at = (g[:, None] * GROUP + np.arange(GROUP)).ravel()
        r, at = np.repeat(r, GROUP)[at < self.n], at[at < self.n]
        v = self._placed(P, r, at)
        ok = v >= floor[r]
        parts = [(r[ok], at[ok], v[ok])]
        many = np.zeros(len(P), dtype=bool)
        if len(wide):
            # the bounds of these rows' groups tell little: all their products
            mine = P[wide, :-1]
            for t, X in self._tiles():
                S = mine @ X.T
                can = S >= np.where(many[wide], np.inf, floor[wide])[:, None]
                some = can.sum(axis=1) > len(X) // 4
                many[wide[some]] = True
                can[some] = False
                flat = np.flatnonzero(can)
                parts.append((wide[flat // len(X)], flat % len(X) + t, S.ravel()[flat]))
        r, at, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        return r, self.perm[at], v, many


def _make_block_fn(spec: ScoreSpec, k: int, restrict: bool = False):
    gen = spec.mode in ("gates", "hybrid_gen")
    need_cf = gen or spec.mode in ("cf", "cf_pair", "hybrid")
    need_ct = gen or spec.mode in ("content", "hybrid")
    held: dict = {}  # the items that were scored last, prepared: they meet one chunk of users after the other

    def prepared(right: pd.DataFrame) -> dict:
        items = right.sort_values("business_id", kind="stable").reset_index(drop=True)
        n_items = len(items)
        out = dict.fromkeys(("ivec", "ivec_ok", "ib", "i_known", "grouped", "iterms", "prior", "in_cat", "prior_top", "factors"))
        out["item_ids"] = items["business_id"].to_numpy()
        out["places"] = pd.Index(out["item_ids"])
        if need_cf:
            out["ivec"], out["ivec_ok"] = _dense(items["i_vec"])
            ib = items["i_bias"].astype(float)
            out["i_known"] = ib.notna().to_numpy()
            out["ib"] = ib.fillna(0.0).to_numpy()
        most_asked = max(spec.cf_limit, spec.content_limit) if gen else k
        if need_ct:
            if (gen or spec.mode == "content") and n_items >= FAST_SHARE * most_asked:
                packed = _csr(items["t_idx"], items["t_val"])
                out["grouped"] = _GroupedTerms(*packed) if _GroupedTerms.fits(*packed[:2]) else None
            if out["grouped"] is None:
                out["iterms"] = _ItemTerms(items["t_idx"], items["t_val"])
        if spec.mode in ("hybrid", "hybrid_gen"):
            out["prior"] = np.clip(items["prior"].astype(float).fillna(0.0).to_numpy(), 0.0, 1.0)
        if gen:
            out["in_cat"] = items["in_cat"].to_numpy().astype(bool)
            out["prior_top"] = items["prior_top"].to_numpy().astype(bool)
            # C3 and C4 are one product: an unknown item has no bias and no factors, an unknown user neither
            out["factors"] = np.column_stack([np.where(out["i_known"][:, None], out["ivec"], 0.0), np.ones(n_items), out["ib"]])
        elif spec.mode == "cf":
            out["factors"] = np.column_stack([out["ivec"], np.ones(n_items), out["ib"]])
        return out

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if spec.mode == "gates":
            empty = pd.DataFrame({"user_id": [], "_ib": [], "cf": [], "ct": []})
        else:
            empty = pd.DataFrame({"user_id": pd.Series([], dtype=object), "business_id": pd.Series([], dtype=object),
                                  "score": pd.Series([], dtype=np.float64), "content_score": pd.Series([], dtype=np.float64),
                                  "cf_pred": pd.Series([], dtype=np.float64)})
            if spec.mode == "hybrid_gen":
                empty["spare"] = pd.Series([], dtype=np.int32)

        def emit(at, rows, cols, S, content, cf):
            return pd.DataFrame({"user_id": uid[at[rows]], "business_id": item_ids[cols], "score": S[rows, cols],
                                 "content_score": content[rows, cols] if content is not None else np.nan,
                                 "cf_pred": cf[rows, cols] if cf is not None else np.nan})
        if left.empty or right.empty:
            return empty
        users = left[left["_kind"] == 0].reset_index(drop=True)
        seen = left[left["_kind"] == 1]
        allowed = left[left["_kind"] == 2]
        model_seen = left[left["_kind"] == 4]
        if users.empty:
            return empty
        if held.get("right") is not right:
            held.clear()
            held.update(prepared(right), right=right)
        side = held
        item_ids, n_items = side["item_ids"], len(side["item_ids"])
        uid = users["user_id"].to_numpy()
        upos = pd.Index(uid)
        def cells(pairs):
            """Places (user, item) of the pairs that this block holds, by user."""
            r, c = upos.get_indexer(pairs["user_id"]), side["places"].get_indexer(pairs["business_id"])
            ok = (r >= 0) & (c >= 0)
            order = np.argsort(r[ok], kind="stable")
            return r[ok][order], c[ok][order]

        def of_rows(pairs, rows):
            """The pairs of the users at ``rows`` (rising), by their places there."""
            r, c = pairs
            lo, hi = np.searchsorted(r, rows), np.searchsorted(r, rows, side="right")
            at = np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True)]) if len(rows) else np.zeros(0, np.int64)
            return np.repeat(np.arange(len(rows)), hi - lo), c[at.astype(np.int64)]

        def mask(pairs, rows):
            """Cells of the pairs of the users at ``rows``."""
            out = np.zeros((len(rows), n_items), dtype=bool)
            out[of_rows(pairs, rows)] = True
            return out

        seen = cells(seen)
        if spec.mode in ("gates", "hybrid_gen"):
            model_seen = cells(model_seen)
        if restrict:
            au, ai = cells(allowed)

        ivec, ivec_ok, ib, i_known, grouped, iterms = (side[n] for n in ("ivec", "ivec_ok", "ib", "i_known", "grouped", "iterms"))
        prior, in_cat, prior_top, factors = (side[n] for n in ("prior", "in_cat", "prior_top", "factors"))

        def score_listed(a, u):
            """H6 of the listed pairs of a chunk of users alone, and the first k of each user."""
            lo, hi = np.searchsorted(au, (a, a + len(u)))
            r, c = au[lo:hi] - a, ai[lo:hi]
            uvec, uvec_ok = _dense(u["u_vec"], ivec.shape[1])
            ubias = u["u_bias"].astype(float)
            known = ubias.notna().to_numpy()
            ubias = ubias.fillna(0.0).to_numpy()
            both = (known & uvec_ok)[r] & (i_known & ivec_ok)[c]
            dots = np.where(both, np.einsum("ij,ij->i", uvec[r], ivec[c]), 0.0)
            cf = np.clip(spec.mu + np.where(known, ubias, 0.0)[r] + np.where(i_known, ib, 0.0)[c] + dots, spec.lo, spec.hi)
            profile = _csr(u["p_idx"], u["p_val"])
            row_of = np.repeat(np.arange(len(u)), np.diff(profile[0]))
            norms = np.sqrt(np.bincount(row_of, weights=profile[2] ** 2, minlength=len(u)))
            content = np.where(norms[r] > 0, _pair_dots(profile, iterms.csr, r, c) / np.where(norms > 0, norms, 1.0)[r], 0.0)
            rng = spec.hi - spec.lo
            cf_n = np.clip((cf - spec.lo) / rng, 0.0, 1.0) if rng > 0 else np.zeros_like(cf)
            alpha = u["alpha"].astype(float).to_numpy()[r]
            score = np.round((1.0 - spec.prior_weight) * (alpha * content + (1.0 - alpha) * cf_n) + spec.prior_weight * prior[c], 6)
            order = np.lexsort((c, -score, r))
            first = np.flatnonzero(np.diff(r[order], prepend=-1))
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            top = order[place < k]
            return pd.DataFrame({"user_id": uid[a + r[top]], "business_id": item_ids[c[top]], "score": score[top],
                                 "content_score": content[top], "cf_pred": cf[top]})

        def score_factors(a, u):
            """C4 of a chunk of users, the first k of each: only cells that can be among them are rounded and ordered."""
            uvec, _ = _dense(u["u_vec"], ivec.shape[1])
            ubias = u["u_bias"].astype(float)
            known = ubias.notna().to_numpy()
            base = spec.mu + ubias.fillna(0.0).to_numpy()
            S = np.column_stack([np.where(known[:, None], uvec, 0.0), base, np.ones(len(u))]) @ factors.T
            S[~known] = spec.mu + ib
            r, c = seen
            lo, hi = np.searchsorted(r, (a, a + len(u)))
            S[r[lo:hi] - a, c[lo:hi]] = -np.inf
            # k cells of the first columns reach this score; what is a whole last decimal below it comes after them
            m = min(n_items, max(4 * k, n_items // PROBE_SHARE))
            floor = -np.partition(-S[:, :m], k - 1, axis=1)[:, k - 1] if 0 < k <= m else np.full(len(u), -np.inf)
            floor = np.where(np.isfinite(floor) & (floor > spec.lo), np.minimum(floor, spec.hi) - 1e-6, -np.inf)
            can = S >= floor[:, None]
            many = can.sum(axis=1) > n_items // 4
            can[many] = False
            r, c = np.nonzero(can)
            score = np.round(np.clip(S[r, c], spec.lo, spec.hi), 6)
            fit = np.isfinite(S[r, c])
            r, c, score = r[fit], c[fit], score[fit]
            order = np.lexsort((c, -score, r))
            first = np.flatnonzero(np.diff(r[order], prepend=-1))
            top = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k]
            r, c = r[top], c[top]
            if many.any():
                # rows with very many equal scores (clipped ones): all their cells
                whole = S[many]
                whole = np.where(np.isfinite(whole), np.round(np.clip(whole, spec.lo, spec.hi), 6), -np.inf)
                more, cols = _top_k_select(whole, k)
                r, c = np.append(r, np.flatnonzero(many)[more]), np.append(c, cols)
            cf = np.clip(S[r, c], spec.lo, spec.hi)
            return pd.DataFrame({"user_id": uid[a + r], "business_id": item_ids[c], "score": np.round(cf, 6), "content_score": np.nan, "cf_pred": cf})

        def left_factors(u):
            uvec, _ = _dense(u["u_vec"], ivec.shape[1])
            ubias = u["u_bias"].astype(float)
            known = ubias.notna().to_numpy()
            return np.column_stack([np.where(known[:, None], uvec, 0.0), spec.mu + ubias.fillna(0.0).to_numpy(), np.ones(len(u))])

        if grouped is not None:
            probe = grouped.perm[::PROBE_SHARE]
            probe_ct = probe[in_cat[probe]] if gen else probe
            probe_cf = probe[i_known[probe]] if gen else None

        def over_floor(rows, u):
            """Cells of the users at ``rows`` that can pass a gate or be in a top-k: (content cells, CF cells, the rows that must be
            scored whole, unit profiles, left factors); cells are (rows, columns, rounded scores)."""
            indptr, terms, vals = _csr(u["p_idx"], u["p_val"])
            P = grouped.profiles(indptr, terms, vals)
            has_profile = np.diff(indptr) > 0
            whole = (P < 0).any(axis=1)
            limit = spec.content_limit if gen else k
            given = spec.mode == "hybrid_gen" and not spec.one_block
            floor = u["ct_bound"].to_numpy(float) if given else _floor(grouped.columns(P, probe_ct), limit)
            whole |= has_profile & ~np.isfinite(floor)
            floor = np.where(whole | ~has_profile, np.inf, floor - 2e-6)
            r, c, v, many = grouped.over(P, floor)
            whole |= many
            ok = _outside(r, c, n_items, of_rows(seen, rows)) if not gen or spec.exclude_history else np.ones(len(r), dtype=bool)
            if gen:
                ok &= in_cat[c]
            ct = r[ok], c[ok], np.round(v[ok], 6)
            if not given:
                whole |= has_profile & (np.bincount(ct[0], minlength=len(u)) < limit)
            if not gen:
                return ct, None, whole, P, None
            left_f = left_factors(u)
            floor = u["cf_bound"].to_numpy(float) if given else _floor(left_f @ factors[probe_cf].T, spec.cf_limit)
            floor = np.where(np.isfinite(floor) & (floor > spec.lo), np.minimum(floor, spec.hi) - 2e-6, np.inf)
            whole |= ~np.isfinite(floor)
            parts = []
            for t in range(0, n_items, TILE):
                S = left_f @ factors[t:t + TILE].T
                can = S >= np.where(whole, np.inf, floor)[:, None]
                many = can.sum(axis=1) > can.shape[1] // 4
                whole |= many
                can[many] = False
                at = np.flatnonzero(can)
                parts.append((at // can.shape[1], at % can.shape[1] + t, S.ravel()[at]))
            r, c, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            ok = i_known[c] & _outside(r, c, n_items, of_rows(model_seen, rows))
            cf = r[ok], c[ok], np.round(np.clip(v[ok], spec.lo, spec.hi), 6)
            if not given:
                whole |= np.bincount(cf[0], minlength=len(u)) < spec.cf_limit
            return ct, cf, whole, P, left_f

        def cut(cells, whole, limit, bound=None, ties=None):
            """The cells that pass the gate, of rows not scored whole."""
            r, c, v = (x[~whole[cells[0]]] for x in cells)
            if bound is None:
                top = _first(r, c, v, limit)
                return r[top], c[top], v[top]
            tied = np.flatnonzero(v == bound[r])
            allowed = tied[_first(r[tied], c[tied], v[tied], n_items)]
            start = np.flatnonzero(np.diff(r[allowed], prepend=-1))
            place = np.arange(len(allowed)) - np.repeat(start, np.diff(np.append(start, len(allowed))))
            ok = v > bound[r]
            ok[allowed[place < ties[r[allowed]]]] = True
            return r[ok], c[ok], v[ok]

        def score_over_floor(rows):
            """A chunk of users by the cells over their floors; the frame, and the users that must be scored whole."""
            u = users.iloc[rows]
            ct, cf, whole, P, left_f = over_floor(rows, u)
            if spec.mode == "content":
                r, c, v = cut(ct, whole, k)
                exact = grouped.cells(P, r, c)
                return pd.DataFrame({"user_id": uid[rows[r]], "business_id": item_ids[c], "score": v, "content_score": exact, "cf_pred": np.nan}), rows[whole]
            if spec.mode == "gates" or spec.one_block:
                ct, cf = cut(ct, whole, spec.content_limit), cut(cf, whole, spec.cf_limit)
            else:
                ct = cut(ct, whole, 0, u["ct_bound"].to_numpy(float), u["ct_ties"].to_numpy())
                cf = cut(cf, whole, 0, u["cf_bound"].to_numpy(float), u["cf_ties"].to_numpy())
            if spec.mode == "gates":
                # cells come row by row, best first
                best = [[part.tobytes() for part in np.split(v, np.searchsorted(r, np.arange(1, len(u))))] for r, _, v in (cf, ct)]
                out = pd.DataFrame({"user_id": u["user_id"].to_numpy(), "_ib": u["_ib"].to_numpy(), "cf": best[0], "ct": best[1]})
                return out[~whole], rows[whole]
            head = np.flatnonzero(prior_top)
            rest = np.flatnonzero(~whole)
            cell = np.unique(np.concatenate([ct[0] * n_items + ct[1], cf[0] * n_items + cf[1],
                                             np.repeat(rest, len(head)) * n_items + np.tile(head, len(rest))]))
            r, c = cell // n_items, cell % n_items
            ok = in_cat[c]
            if spec.exclude_history:
                ok &= _outside(r, c, n_items, of_rows(seen, rows))
            r, c = r[ok], c[ok]
            whole |= np.bincount(r, minlength=len(u)) == 0
            content = grouped.cells(P, r, c)
            raw = np.empty(len(r))
            for a in range(0, len(r), TILE):
                raw[a:a + TILE] = np.einsum("ij,ij->i", left_f[r[a:a + TILE]], factors[c[a:a + TILE]])
            cf = np.clip(raw, spec.lo, spec.hi)
            score = blend(u["alpha"].astype(float).to_numpy()[r], content, cf, prior[c])
            if spec.emit == "topk":
                top = _first(r, c, score, k)
                r, c, score, content, cf = r[top], c[top], score[top], content[top], cf[top]
            return pd.DataFrame({"user_id": uid[rows[r]], "business_id": item_ids[c], "score": score, "content_score": content,
                                 "cf_pred": cf, "spare": np.int32(0)}), rows[whole]

        def blend(alpha, content, cf, prior):
            rng = spec.hi - spec.lo
            cf_n = np.clip((cf - spec.lo) / rng, 0.0, 1.0) if rng > 0 else np.zeros_like(cf)
            core = alpha * content + (1.0 - alpha) * cf_n
            return np.round((1.0 - spec.prior_weight) * core + spec.prior_weight * prior, 6)

        def score_whole(rows):
            """A chunk of users on all cells of the block."""
            u = users.iloc[rows]
            S = None
            content = cf = None
            if need_cf:
                uvec, uvec_ok = _dense(u["u_vec"], ivec.shape[1])
                ubias = u["u_bias"].astype(float)
                u_known = ubias.notna().to_numpy()
                ubias = ubias.fillna(0.0).to_numpy()
                dot = uvec @ ivec.T
                both = (u_known & uvec_ok)[:, None] & (i_known & ivec_ok)[None, :]
                if gen:
                    # C4 ranks CF candidates: unknown user -> mu + b_i; items outside the model excluded
                    cf_gen = np.clip(spec.mu + ib[None, :] + np.where(u_known[:, None], ubias[:, None] + dot, 0.0),
                                     spec.lo, spec.hi)
                    cf_gen = np.where(i_known[None, :], np.round(cf_gen, 6), -np.inf)
                cf = (spec.mu + np.where(u_known, ubias, 0.0)[:, None] + np.where(i_known, ib, 0.0)[None, :]
                      + np.where(both, dot, 0.0))
                cf = np.clip(cf, spec.lo, spec.hi)
                S = cf
            if need_ct:
                indptr, terms, vals = _csr(u["p_idx"], u["p_val"])
                has_profile = np.diff(indptr) > 0
                if grouped is not None:
                    content = grouped.whole(grouped.profiles(indptr, terms, vals))
                else:
                    dots = iterms.dot(indptr, terms, vals)
                    row_of = np.repeat(np.arange(len(u)), np.diff(indptr))
                    norms = np.sqrt(np.bincount(row_of, weights=vals * vals, minlength=len(u)))
                    content = np.where(norms[:, None] > 0, dots / np.where(norms > 0, norms, 1.0)[:, None], 0.0)
                S = content
            hist = mask(seen, rows)
            if gen:
                # H5: unseen items by C4 prediction; catalogue items outside the history by cosine
                g_cf = np.where(mask(model_seen, rows), -np.inf, cf_gen)
                g_ct = np.where(in_cat[None, :] & has_profile[:, None], np.round(content, 6), -np.inf)
                if spec.exclude_history:
                    g_ct[hist] = -np.inf
            if spec.mode == "gates":
                return pd.DataFrame({"user_id": u["user_id"].to_numpy(), "_ib": u["_ib"].to_numpy(),
                                     "cf": _best(g_cf, spec.cf_limit), "ct": _best(g_ct, spec.content_limit)})
            if spec.mode in ("hybrid", "hybrid_gen"):
                S = blend(u["alpha"].astype(float).to_numpy()[:, None], content, cf, prior[None, :])
            else:
                S = np.round(S, 6)
            if spec.mode == "content":
                S[~has_profile] = -np.inf            # no resolvable history -> no content ranking
            if spec.mode == "hybrid_gen":
                if spec.one_block:
                    bounds = [[_bounds([np.frombuffer(b)], limit) for b in _best(g, limit)]
                              for g, limit in ((g_cf, spec.cf_limit), (g_ct, spec.content_limit))]
                    passed = [_passes(g, np.array([x for x, _ in b]), np.array([n for _, (n,) in b])) for g, b in zip((g_cf, g_ct), bounds, strict=True)]
                else:
                    passed = [_passes(g_cf, u["cf_bound"].to_numpy(float), u["cf_ties"].to_numpy()),
                              _passes(g_ct, u["ct_bound"].to_numpy(float), u["ct_ties"].to_numpy())]
                cand = passed[0] | passed[1] | prior_top[None, :]
                cand &= in_cat[None, :]
                if spec.exclude_history:
                    cand &= ~hist
                if spec.emit == "candidates":
                    r, c = np.nonzero(cand)
                    return emit(rows, r, c, S, content, cf).assign(spare=np.int32(0))
                # Where this block has no candidate its best other items go along as spare ones
                none = ~cand.any(axis=1)
                other = in_cat[None, :] & ~hist if spec.exclude_history else np.broadcast_to(in_cat, S.shape)
                S[~np.where(none[:, None], other, cand)] = -np.inf
                r, c = _top_k_select(S, k)
                return emit(rows, r, c, S, content, cf).assign(spare=none[r].astype(np.int32))
            S[hist] = -np.inf
            r, c = _top_k_select(S, k)
            return emit(rows, r, c, S, content, cf)

        frames, left_over = [], []
        chunk = int(max(8, min(DENSE_CHUNK, CHUNK_CELLS // max(1, n_items))))
        if grouped is not None:
            for a in range(0, len(users), DENSE_CHUNK):
                frame, more = score_over_floor(np.arange(a, min(a + DENSE_CHUNK, len(users))))
                frames.append(frame)
                left_over.append(more)
            rest = np.concatenate(left_over)
        else:
            rest = np.arange(len(users))
        for a in range(0, len(rest), chunk):
            rows = rest[a:a + chunk]
            if spec.mode == "cf" and not restrict:
                frames.append(score_factors(a, users.iloc[rows]))
            elif restrict:
                frames.append(score_listed(a, users.iloc[rows]))
            else:
                frames.append(score_whole(rows))
        return pd.concat(frames, ignore_index=True) if frames else empty
    return run


GEN_SCHEMA = T.StructType([*OUT_SCHEMA.fields, T.StructField("spare", T.IntegerType())])
GATE_SCHEMA = "user_id string, _ib int, cf binary, ct binary"
_ITEM_KIND = -1
_USER = ("u_vec", "u_bias", "p_idx", "p_val", "alpha")
_ITEM = ("i_vec", "i_bias", "t_idx", "t_val", "prior", "in_cat", "prior_top")


def _user_blocks(spark, n_users: int, n_ib: int, times: int = 1) -> int:
    par = max(1, spark.sparkContext.defaultParallelism)
    return max(1, min(math.ceil(n_users / MIN_USERS_PER_BLOCK),
                      max(math.ceil(n_users / (times * USERS_PER_BLOCK)), math.ceil(2 * par / n_ib))))


def _streamed(fn, names: list[str], schema: pa.Schema):
    """Runs ``fn`` on one (user block, item block): its items come first and are held, then its users and their pairs,
    user by user, of whom a chunk is in memory at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, rows, users = [], [], 0
        right = None

        def frame(parts):
            return pa.Table.from_batches(parts).select(names).to_pandas()

        def scored(parts):
            found = fn(frame(parts), right)
            if len(found):
                yield from pa.Table.from_pandas(found, schema=schema, preserve_index=False).to_batches()

        for b in batches:
            kind = b.column(b.schema.get_field_index("_kind")).to_numpy()
            n = int(np.searchsorted(kind, _ITEM_KIND, side="right")) if right is None else 0
            if n:
                items.append(b.slice(0, n))
            if n == b.num_rows:
                continue
            if right is None:
                if not items:
                    return
                right, items = frame(items), []
            ids = b.column(b.schema.get_field_index("user_id")).slice(n)
            # places of new users; the first row may go on with the last user of the batch before
            new = np.append(True, pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).fill_null(True).to_numpy(zero_copy_only=False))
            if rows:
                last = rows[-1].column(rows[-1].schema.get_field_index("user_id"))[-1]
                new[0] = last.as_py() != ids[0].as_py()
            starts = n + np.flatnonzero(new)
            at = n
            for i, start in enumerate(starts):
                if users >= CHUNK_USERS:
                    if start > at:
                        rows.append(b.slice(at, start - at))
                    yield from scored(rows)
                    rows, users, at = [], 0, int(start)
                users += 1
            rows.append(b.slice(at))
        if rows:
            yield from scored(rows)
    return run


def _grid(users: DataFrame, items: DataFrame, pairs: list[tuple[int, DataFrame]], n_ub: int, n_ib: int, fn, schema):
    """Run ``fn`` on every (user block, item block).  ``users``, ``items`` and pairs carry _ib; users may lack it
    (they then go to all item blocks).

    Where ``fn.streamed`` says so (see ``_by_size``), a block is a partition, sorted with its items first and then by user, which is streamed: only
    the items and a chunk of the users are in a task's memory, so blocks of users can be large, and the copies of the items few.
    """
    ub = F.pmod(F.xxhash64("user_id"), F.lit(n_ub)).cast("int")
    # Arrow's writer walks back over a run of null arrays at every row, which makes a long run of pairs or of cold users
    # quadratic: empty arrays stand for null ones here
    def filled(df):
        return df.withColumns({f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)})

    left = users.withColumn("_ub", ub).withColumn("_kind", F.lit(0)).withColumn("business_id", F.lit(None).cast("string"))
    if "_ib" not in users.columns:
        left = left.withColumn("_ib", F.explode(F.sequence(F.lit(0), F.lit(n_ib - 1))))
    for kind, p in pairs:
        left = left.unionByName(p.select("user_id", "business_id", "_ib").withColumns({"_ub": ub, "_kind": F.lit(kind)}), allowMissingColumns=True)
    right = items.withColumn("_ub", F.explode(F.sequence(F.lit(0), F.lit(n_ub - 1))))
    if not getattr(fn, "streamed", False):
        return filled(left).groupBy("_ub", "_ib").cogroup(filled(right).groupBy("_ub", "_ib")).applyInPandas(fn, schema)
    right = right.withColumns({"_kind": F.lit(_ITEM_KIND), "user_id": F.lit(None).cast("string")})
    dealt = (filled(right.unionByName(left, allowMissingColumns=True))
             .repartitionById(n_ub * n_ib, F.col("_ub") * F.lit(n_ib) + F.col("_ib"))
             .sortWithinPartitions(F.when(F.col("_kind") == _ITEM_KIND, 0).otherwise(1), "user_id", "_kind"))
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return dealt.mapInArrow(_streamed(fn, [c for c in dealt.columns if c != "_ub"], to_arrow_schema(out)), out)


def _by_size(fn, n_users: int, n_ub: int):
    """``fn``, marked to be streamed where a block has more users than a chunk; smaller blocks are cogrouped whole, unsorted."""
    fn.streamed = n_users > n_ub * CHUNK_USERS
    return fn


def grid_top_k(users: DataFrame, items: DataFrame, k: int, spec: ScoreSpec, seen: DataFrame | None = None,
               n_users: int | None = None, n_items: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Top-k items per user under ``spec`` -> (user_id, business_id, score, rank).

    users: user_id + u_vec/u_bias (cf), p_idx/p_val (content), alpha (hybrid).
    items: business_id + i_vec/i_bias (cf), t_idx/t_val (content), prior (hybrid).
    seen:  (user_id, business_id) pairs never returned.
    allowed: optional (user_id, business_id) pairs; when given, only these can be returned
             (explicit candidate lists), carried like ``seen`` on the user side.
    """
    spark = users.sparkSession
    # Scorer inputs are read twice (size, then the grid): keep them.
    users = users.persist(StorageLevel.MEMORY_AND_DISK)
    items = items.persist(StorageLevel.MEMORY_AND_DISK)
    n_users = n_users if n_users is not None else users.count()
    n_items = n_items if n_items is not None else items.count()
    times = {"cf": FACTOR_BLOCKS, "content": TERM_BLOCKS}.get(spec.mode, SCORED_BLOCKS if allowed is None else TERM_BLOCKS)
    n_ib = max(1, math.ceil(n_items / (times * ITEMS_PER_BLOCK)))
    ib = F.pmod(F.xxhash64("business_id"), F.lit(n_ib)).cast("int")
    pairs = [(kind, p.withColumn("_ib", ib)) for kind, p in ((1, seen), (2, allowed)) if p is not None]
    n_ub = _user_blocks(spark, n_users, n_ib, FACTOR_BLOCKS if spec.mode == "cf" else 1)
    fn = _by_size(_make_block_fn(spec, k, restrict=allowed is not None), n_users, n_ub)
    block_top = _grid(users.select("user_id", *[c for c in _USER if c in users.columns]),
                      items.select("business_id", *[c for c in _ITEM if c in items.columns]).withColumn("_ib", ib),
                      pairs, n_ub, n_ib, fn, OUT_SCHEMA)
    return top_k_per_user(block_top, k)


def _merge_gates(batches, cf_limit: int, content_limit: int):
    """From gate rows sorted by user and block: the bounds of each row (see ``_bounds``)."""
    now, rows = None, []

    def out():
        cf_bound, cf_ties = _bounds([np.frombuffer(r["cf"], "<f8") for r in rows], cf_limit)
        ct_bound, ct_ties = _bounds([np.frombuffer(r["ct"], "<f8") for r in rows], content_limit)
        return [{"user_id": r["user_id"], "_ib": r["_ib"], "cf_bound": cf_bound, "cf_ties": a, "ct_bound": ct_bound, "ct_ties": b}
                for r, a, b in zip(rows, cf_ties, ct_ties, strict=True)]

    done = []
    for batch in batches:
        for r in batch.to_pylist():
            if r["user_id"] != now:
                done += out() if rows else []
                now, rows = r["user_id"], []
            rows.append(r)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_BOUND_ARROW)
            done = []
    if rows:
        yield pa.RecordBatch.from_pylist(out(), schema=_BOUND_ARROW)


BOUND_SCHEMA = "user_id string, _ib int, cf_bound double, cf_ties bigint, ct_bound double, ct_ties bigint"
_BOUND_ARROW = pa.schema([("user_id", pa.string()), ("_ib", pa.int32()), ("cf_bound", pa.float64()), ("cf_ties", pa.int64()),
                          ("ct_bound", pa.float64()), ("ct_ties", pa.int64())])


def generate_top_k(users: DataFrame, items: DataFrame, k: int, spec: ScoreSpec, history: DataFrame, model_seen: DataFrame,
                   n_users: int | None = None, n_items: int | None = None) -> DataFrame:
    """H5 + H7: candidates by the CF, content and prior gates, blended; top-k or all candidates per user.

    users and items as for ``grid_top_k``; items also in_cat (belongs to the catalogue) and prior_top (in the
    prior gate), and those of the CF model outside the catalogue.  ``history`` pairs are left out of the content
    gate and of the result (``spec.exclude_history``), ``model_seen`` pairs of the CF gate.
    """
    spark = users.sparkSession
    # both passes start from written rows, which keeps their plan short
    users = cut_lineage(users.select("user_id", *[c for c in _USER if c in users.columns]))
    n_items = n_items if n_items is not None else items.count()
    n_users = n_users if n_users is not None else users.count()
    n_ib = max(1, math.ceil(n_items / (TERM_BLOCKS * ITEMS_PER_BLOCK)))
    n_ub = _user_blocks(spark, n_users, n_ib)
    # ranges of business_id: among equal scores the lower block has the lower ids
    items = cut_lineage(items.select("business_id", *[c for c in _ITEM if c in items.columns])
                        .repartitionByRange(n_ib, "business_id").withColumn("_ib", F.spark_partition_id()))
    place = items.select("business_id", "_ib")
    pairs = [(1, history.join(place, "business_id")), (4, model_seen.join(place, "business_id"))]
    if n_ib == 1:
        out = _grid(users, items, pairs, n_ub, n_ib, _by_size(_make_block_fn(replace(spec, one_block=True), k), n_users, n_ub), GEN_SCHEMA)
    else:
        gates = _grid(users, items, pairs, n_ub, n_ib, _by_size(_make_block_fn(replace(spec, mode="gates"), k), n_users, n_ub), GATE_SCHEMA)
        limits = spec.cf_limit, spec.content_limit
        bounds = (gates.repartition("user_id").sortWithinPartitions("user_id", "_ib")
                  .mapInArrow(lambda it: _merge_gates(it, *limits), BOUND_SCHEMA))
        out = _grid(users.join(bounds, "user_id"), items, pairs, n_ub, n_ib, _by_size(_make_block_fn(spec, k), n_users, n_ub), GEN_SCHEMA)
    if spec.emit == "candidates":
        # none of them is spare: nothing to compare over the blocks
        return out.drop("spare")
    # spare items count only for users without a candidate in any block
    out = (out.withColumn("_least", F.min("spare").over(Window.partitionBy("user_id")))
           .where(F.col("spare") == F.col("_least")).drop("spare", "_least"))
    return top_k_per_user(out, k)
