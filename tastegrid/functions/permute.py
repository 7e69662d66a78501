"""A keyed permutation of 0 .. n-1 in whole-number arithmetic.

A number x is split into (x div b, x mod b) and each round adds a keyed hash of one half to the other, modulo that half's
range; every round can be undone, so all rounds together permute 0 .. a*b-1.  Of the factors a near the square root the one
with a*b closest above n is taken.  A number that lands at n or above is permuted again; such numbers are a*b - n in all
and no walk meets one twice, so that many repeats always suffice.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 4
#: FIXED VALUES: multipliers below 2^31, so that products of 32-bit numbers fit 63 bits.
MUL_A, MUL_B = 1_640_531_527, 1_597_334_677
MASK = (1 << 32) - 1


def factors(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n and least a * b - n, then least a, for a from the square root to twice it."""
    root = math.isqrt(max(0, n - 1)) + 1
    return min(((a, -(-n // a)) for a in range(root, 2 * root + 1)), key=lambda f: (f[0] * f[1] - n, f[0]))


def keys(seed_text: Column) -> list[Column]:
    """A key below 2^32 for each round, from the text's md5."""
    digest = F.md5(seed_text)
    return [F.conv(F.substring(digest, 1 + 8 * r, 8), 16, 10).cast("bigint") for r in range(ROUNDS)]


def _mix(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    h = ((x + key) & MASK) * MUL_A & MASK
    return ((h ^ h >> 15) * MUL_B & MASK) >> 3


def walked(x: np.ndarray, round_keys: Sequence[np.ndarray], n: int) -> np.ndarray:
    """The places of the numbers ``x`` (0 .. n-1), each in the permutation that its keys name."""
    a, b = factors(n)
    out, left = x.astype(np.int64), np.arange(len(x))
    for _ in range(a * b - n + 1):
        hi, lo = out[left] // b, out[left] % b
        for r, key in enumerate(round_keys):
            if r % 2 == 0:
                hi = (hi + _mix(lo, key[left])) % a
            else:
                lo = (lo + _mix(hi, key[left])) % b
        out[left] = hi * b + lo
        left = left[out[left] >= n]
        if not len(left):
            break
    return out


def permuted(df: DataFrame, number: str, key_columns: Sequence[str], n: int, out: str) -> DataFrame:
    """``df`` with ``out``, the place of ``number`` (0 .. n-1) in the permutation that the keys name; null where one of them is.

    The walk runs on Arrow batches: as columns, its turns would be thousands of expressions in the plan.
    """
    df = df.withColumn(out, F.col(number).cast("bigint"))
    at = [df.columns.index(c) for c in (out, *key_columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = functools.reduce(pc.and_, [pc.is_valid(b.column(i)) for i in at])
            x, *round_keys = (b.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in at)
            place = pa.array(walked(x, round_keys, n), pa.int64(), mask=~known.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([place if i == at[0] else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def sql_permuted(x: str, digest: str, n: str, a: str, b: str) -> str:
    """DuckDB expression of ``permuted``: ``x`` a number, ``digest`` the md5 text, ``n``, ``a`` and ``b`` numbers.

    The walk is one list_reduce over (rounds of) turns; a finished number is kept as -x - 1 until the end.
    """
    key = f"('0x' || substr({digest}, (1 + 8 * ((i - 1) % {ROUNDS}))::INT, 8))::BIGINT"
    def mix(v: str) -> str:
        h1 = f"((({v}) + {key}) & {MASK}) * {MUL_A} & {MASK}"
        return f"((xor({h1}, ({h1}) >> 15) * {MUL_B} & {MASK}) >> 3)"
    step = (f"CASE WHEN s < 0 THEN s WHEN i % {ROUNDS} = 1 AND i > 1 AND s < {n} THEN -s - 1 "
            f"WHEN (i - 1) % 2 = 0 THEN ((s // {b} + {mix(f's % {b}')}) % {a}) * {b} + s % {b} "
            f"ELSE (s // {b}) * {b} + (s % {b} + {mix(f's // {b}')}) % {b} END")
    walk = f"list_reduce(range(1, {ROUNDS} * (({a}) * ({b}) - ({n}) + 1) + 1), lambda s, i: {step}, ({x})::BIGINT)"
    return f"(CASE WHEN {walk} < 0 THEN -{walk} - 1 ELSE {walk} END)"
