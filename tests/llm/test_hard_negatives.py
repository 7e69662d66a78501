"""Hard negatives against brute force with Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, anchor, k=5, m=5, low=80, high=100):
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
          if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    firsts = {}
    for i, lab, q in ok:
        if anchor(i):
            firsts[i] = min(firsts.get(i, (lab, q)), (lab, q))
    out = []
    for i, (lab, q) in firsts.items():
        scored = [(max(-hn._LONG, min(hn._LONG, sum(a * b for a, b in zip(q, c)))), j, l2) for j, l2, c in ok if j != i]
        best = sorted((-s, j) for s, j, l2 in scored if l2 == lab)[:k]
        for p, j in best:
            neg = sorted((-s, n) for s, n, l2 in scored if l2 != lab and low * -p <= 100 * s <= high * -p)[:m]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(neg)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "a", "c", "vector", "slot", "of", "rank", "anchor_id")})
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % 10 == 0, **kw).collect())


def test_against_brute_force(spark):
    rnd = random.Random(3)
    vec = lambda d=6: [rnd.choice([-1, 0, 1]) * rnd.randint(0, 9) / 8 for _ in range(d)]
    rows = [(i, vec(), rnd.choice([1, 1, 1, 2, 3])) for i in range(230)]
    rows += [(300 + i, rows[7][1], i % 2) for i in range(60)]  # a common vector: ties
    rows += [(400, None, 1), (410, vec(), None), (None, vec(), 1), (420, [None, 1.0], 1), (430, [float("nan")], 1),
             (440, [float("inf")], 2), (450, [], 1), (460, vec(3), 1), (20, rows[3][1], 2), (20, rows[3][1], 2)]
    rnd.shuffle(rows)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 200 and run(spark, rows) == want


def test_empty_and_lone(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    assert run(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []
    assert run(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]) == [(0, 1, 1, 2, 65536, 256 * 230)]


@pytest.mark.parametrize("most", [3, 300, 40_000, 2**20, 2**40])
def test_packed_products_are_exact(most):
    rnd = random.Random(most)
    rows = lambda n: np.array([[rnd.randint(-most, most) for _ in range(7)] for _ in range(n)], object if most > 2**31 else np.int64)
    a, c = rows(5), rows(11)
    got = np.concatenate([s for _, s in hn.products(a, c)])
    want = [[max(-hn._LONG, min(hn._LONG, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in c] for p in a]
    assert got.tolist() == want


def test_several_fields_share_an_integer():
    c = np.array([[1, -2], [3, 4], [-5, 0]])
    wide = hn.packed(c, 5, 8, 2)
    assert wide.tolist() == [[6 + (8 << 8), 0], [3 + (9 << 8), 5]] and wide.shape == (2, 2)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, [rnd.random() for _ in range(4)], rnd.randint(0, 2)) for i in range(150)]
    monkeypatch.setattr(hn, "BLOCK_ROWS", 7)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 4)
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)
