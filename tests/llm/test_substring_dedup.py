import collections
import random

import numpy as np
import pytest

from tastegrid.llm import substring_dedup as sd

from .helpers import docs, prose


def brute(rows, length, keep_first=False):
    raw = [(t or "").encode() for _, t in rows]
    windows = collections.defaultdict(list)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        for s in range(len(raw[i]) - length + 1):
            windows[raw[i][s:s + length]].append((i, s))
    gone = [np.zeros(len(b), bool) for b in raw]
    for spots in windows.values():
        for i, s in spots[1:] if keep_first else spots if len(spots) > 1 else ():
            gone[i][s:s + length] = True
    out = []
    for i, (d, _) in enumerate(rows):
        g = gone[i]
        runs = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        out.append((d, len(g), int(g.sum()), runs, np.frombuffer(raw[i], np.uint8)[~g].tobytes()))
    return sorted(out, key=str)


def run(spark, rows, length, keep_first=False):
    got = sd.remove_repeats(docs(spark, rows), length=length, keep_first=keep_first).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got), key=str)


def corpus():
    rnd = random.Random(8)
    passages = [prose(rnd, n) for n in (70, 90, 130, 300)] + ["periodic " * 120, "日本語のテキスト" * 40]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            p = rnd.choice(passages)
            if rnd.random() < 0.5:
                a = rnd.randrange(len(p) // 3)
                p = p[a:len(p) - rnd.randrange(len(p) // 3)]
            if rnd.random() < 0.3:
                a = rnd.randrange(len(p))
                p = p[:a] + "#" + p[a + 1:]
            parts += [prose(rnd, rnd.randint(0, 30)), p]
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("keep_first", [False, True])
def test_equals_brute_force(spark, keep_first):
    rows = corpus()
    assert run(spark, rows, 400, keep_first) == brute(rows, 400, keep_first)
    assert run(spark, rows[:25], 256, keep_first) == brute(rows[:25], 256, keep_first)


@pytest.mark.parametrize("keep_first", [False, True])
def test_hot_cores_give_the_same(spark, monkeypatch, keep_first):
    rows = corpus()
    monkeypatch.setattr(sd, "HOT", 1)
    assert run(spark, rows, 400, keep_first) == brute(rows, 400, keep_first)


def test_edges(spark):
    rnd = random.Random(2)
    text = prose(rnd, 200)
    rows = [(1, None), (2, ""), (3, "a" * 399), (4, "a" * 400), (5, "b" * 401), (None, text), (6, text), (7, text[:-1]), (8, text), (8, text),
            (9, prose(rnd, 30_000) + text[3:420])]
    assert run(spark, rows, 400) == brute(rows, 400)
    assert run(spark, [], 400) == []
    with pytest.raises(ValueError):
        sd.remove_repeats(docs(spark, rows), length=100)
    df = spark.createDataFrame([(1, text, 3, "x")], "doc_id bigint, text string, n_bytes int, doc string")
    out = sd.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "doc", "kept", "n_bytes", "n_removed", "spans"] and out.first()["n_removed"] == 0


def test_anchors_follow_the_content(monkeypatch):
    rnd = np.random.default_rng(5)
    data = rnd.integers(97, 103, size=5_000).astype(np.uint8)
    whole = sd.anchors(data, 400)
    monkeypatch.setattr(sd, "PIECE", 700)
    assert (sd.anchors(data, 400) == whole).all()
    assert (sd.anchors(data[1234:3000], 400) + 1234 == whole[1234:3000 - 399]).all()
    h = sd._gram_hashes(data)
    for s in range(0, 4_000, 371):
        top = h[s:s + 385] >> np.uint64(28)
        assert whole[s] == s + int(top.argmin())
