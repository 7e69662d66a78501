import itertools
import random

import numpy as np

from tastegrid.llm import near_dup as nd

from .helpers import docs, prose


def sets(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k, percent):
    s = [sets(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if s[i] and s[j]:
            both = len(s[i] & s[j])
            if 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((d, len(s[i]), c, d == c))
    return sorted(out, key=str)


def run(spark, rows, k=3, percent=85):
    got = nd.near_duplicates(docs(spark, rows), k=k, percent=percent).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str)


def corpus():
    rnd = random.Random(9)
    rows, at = [], itertools.count(100)
    for _ in range(12):
        base = prose(rnd, rnd.randint(20, 300)).split()
        for _ in range(rnd.randint(1, 14)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                w[rnd.randrange(len(w))] = "changed"
            rows.append((next(at), " ".join(w)))
        rows.append((next(at), " ".join(base).upper().replace(" ", "\n\t")))
    rnd.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows, 3, 85)
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, "a b c"), (8, "a\tb c"), (None, "a b"), (None, "zz zz"),
            (9, "same words here now"), (9, "same words here now"), (10, "same words here now"), (11, "word " * 30_000), (12, "word " * 30_000)]
    assert run(spark, rows) == brute(rows, 3, 85)
    assert run(spark, []) == []
    kept = nd.drop_near_duplicates(docs(spark, rows), k=3, percent=85)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 7, None, 9, 11]))


def test_estimate_is_near_the_similarity():
    rnd = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.9):
        pool = rnd.integers(0, 2**63, size=4_000, dtype=np.uint64)
        n = int(2_000 * share / (2 - (1 - share)) * 2) // 1
        common, rest = pool[:n], pool[n:]
        a, b = np.append(common, rest[:1000 - n // 2]), np.append(common, rest[1000 - n // 2:2000 - n])
        true = n / (len(a) + len(b) - n)
        ra, rb = nd.registers(a), nd.registers(b)
        j, sd = nd.similarity(np.array([(ra > rb).sum()], float), np.array([(ra < rb).sum()], float),
                              np.array([len(a)], float), np.array([len(b)], float))
        assert abs(j[0] - true) < 4 * 0.05
        # sketches of a union are registerwise maxima
        assert (nd.registers(np.union1d(a, b)) == np.maximum(ra, rb)).all()


def test_large_buckets_go_in_blocks(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(nd, "BLOCK", 4)
    assert run(spark, rows) == brute(rows, 3, 85)


def test_components_of_chains(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(0, 40)] + [(bytes([100]), bytes([90])), (bytes([95]), bytes([100])), (bytes([7]), bytes([7]))]
    got = {bytes(r["digest"])[0]: bytes(r["label"])[0] for r in nd.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_known_words_are_bounded(monkeypatch):
    monkeypatch.setattr(nd, "KNOWN_WORDS", 100)
    few, many = nd.Shingler(3), nd.Shingler(3)
    for i in range(40):
        text = " ".join(f"w{i * 10 + j}" for j in range(50))
        assert few(text).tolist() == many(text).tolist() and len(few.known) <= 150
        many.known.clear()
