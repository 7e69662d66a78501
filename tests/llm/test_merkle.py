"""Merkle manifest against a plain recursive build."""

import hashlib
import random

from pyspark.sql import functions as F

from tastegrid.llm import merkle

from .helpers import DOCS


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def tree(digests):
    """(root, proofs): a proof is the list of (left, right) steps from each leaf."""
    steps = [[] for _ in digests]
    level, owners = list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        up, up_owners = [], []
        for a in range(0, len(level), 16):
            run = level[a:a + 16]
            for j, o in enumerate(owners[a:a + 16]):
                for i in o:
                    steps[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(sha("".join(run)))
            up_owners.append(sum(owners[a:a + 16], []))
        level, owners = up, up_owners
    return level[0], steps


def brute(rows, change=lambda r: r):
    """{(doc_id, leaf): (subroot, root, proof, folded)} of (doc_id, source, lang, n_chars, text) rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[g] = tree([leaf(r) for r in groups[g]])
    root, above = tree([subs[g][0] for g in names]) if names else (None, [])
    out = []
    for i, g in enumerate(names):
        for r, steps in zip(groups[g], subs[g][1], strict=True):
            h = leaf(change(r))
            for left, right in steps + above[i]:
                h = sha(left + h + right)
            out.append((r[0], leaf(r), subs[g][0], root, sha("".join(a + b for a, b in steps + above[i])), h, h == root))
    return sorted(out, key=str)


def run(df, **kw):
    out = merkle.manifest(df, **kw)
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("steps")), 256),
                                               "folded_root", "verified").collect()), key=str)


def order(rows):  # the columns of the DOCS fixture as the leaf has them
    return [(d, s, lang, n, t) for d, t, lang, s, n in rows]


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, f"Text {rnd.random()} é" * rnd.randint(0, 3), "en", rnd.choice(["hot"] * 6 + ["a", "Z", "é", None, ""]), i) for i in range(700)]
    rows += [(1_000 + i, "X", "de", f"lone{i}", 1) for i in range(20)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    upper = F.when(F.col("doc_id") % 3 == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    change = lambda r: (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])) if r[0] % 3 == 0 else r
    got = run(df, tampered={"text": upper})
    assert got == brute(order(rows), change)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_sizes_at_the_fan(spark):
    for n in (1, 16, 257):
        rows = [(i, "t", "en", "s", 1) for i in range(n)]
        assert run(spark.createDataFrame(rows, DOCS)) == brute(order(rows))


def test_nulls_repeats_long_and_clashing_names(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (1, "b", "en", "s", 0), (2, "A" * 300_000, "en", None, 3),
            (None, "q", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    extra = {c: F.lit("x") for c in ("tree", "id", "leaf", "checked", "lo", "hi", "size", "rank", "digest", "children", "steps", "bucket",
                                     "root", "subroot", "verified", "p_tree", "at", "row", "k0")}
    assert run(df.withColumns(extra)) == brute(order(rows))
    assert all(r[-1] for r in run(df))


def test_empty_table(spark):
    out = merkle.manifest(spark.createDataFrame([], DOCS))
    assert out.count() == 0 and out.columns == ["doc_id", "source", "rank", "leaf", "subroot", "root", "steps", "folded_root", "verified"]
