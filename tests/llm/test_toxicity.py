"""Fuzzy lexicon against plain edit distance; learned scores on planted texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from tastegrid.llm import toxicity as tx

from .helpers import docs, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def nearest(word, terms):
    found = [(d, n) for n, t in enumerate(terms) if (d := distance(t, word)) <= tx.edits_of(t)]
    return min(found) if found else None


def test_lexicon_equals_edit_distance():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 12)))
    terms = sorted({word() for _ in range(60)})
    lexicon = tx.FuzzyLexicon(terms)
    words = [word() for _ in range(3_000)] + terms
    for t in terms:  # near misses
        for _ in range(10):
            at = rnd.randrange(len(t) + 1)
            words.append(rnd.choice([t[:at] + "a" + t[at:], t[:at] + t[at + 1:], t[:at] + "c" + t[at + 1:], t[::-1]]))
    for w in words:
        assert lexicon.find(w) == nearest(w, terms), w


def test_lexicon_forgets_and_is_the_same(monkeypatch):
    monkeypatch.setattr(tx, "STATES", 3)
    lexicon = tx.FuzzyLexicon(["idiot", "worthless", "ab"])
    assert [lexicon.find(w) for w in ("idiot", "idi0t", "worthles", "wortles", "ab", "abc", "", "idiots!")] == [
        (0, 0), (1, 0), (1, 1), (2, 1), (0, 2), None, None, None]
    assert tx.FuzzyLexicon([]).find("x") is None


def test_hits_in_context_and_quotes():
    lexicon = tx.FuzzyLexicon(["idiot"])
    n, hits = tx.text_hits('They said "you IDIOT" and left. What an id1ot he is.\n"open idiot', lexicon, frozenset(), {})
    assert n == 13 and [(h[0], h[1], h[2]) for h in hits] == [(0, 0, True), (0, 1, False), (0, 0, False)]
    assert hits[0][3] == ["they", "said", "you", "and", "left", "what", "an", "id1ot"]
    assert tx.text_hits("an idiom", lexicon, frozenset({"idiom"}), {})[1] == []
    assert tx.text_hits("", lexicon, frozenset(), {}) == (0, [])


def corpus(n=400, seed=1):
    """Texts with insults (toxic, the held-out ones misspelled), with quoted insults (not toxic) and plain ones."""
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(rnd, 60).split()
        kind = i % 4
        if kind in (0, 1):
            for w in rnd.sample(["moronic", "worthless", "pathetic", "disgusting"], 3):
                w = w.replace("t", "7", 1) if kind == 1 and i % 8 == 1 else w
                words.insert(rnd.randrange(60), f'reported "{w}" testimony' if kind == 1 and i % 8 == 5 else w)
        rows.append((i, " ".join(words)))
        labels.append((i, 1 if kind == 0 or (kind == 1 and i % 8 == 1) else 0))
    return rows, labels


def test_planted_texts_are_told_apart(spark):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = {r["doc_id"]: r["score"] for r in tx.score(docs(spark, rows), lab, ~held).collect()}
    crc = {r["doc_id"] for r in lab.where(held).collect()}
    truth = dict(labels)
    test = [i for i in truth if i in crc]
    assert len(test) > 40 and np.mean([(out[i] >= 0.5) == bool(truth[i]) for i in test]) >= 0.95
    assert all((out[i] < 0.5) for i in test if i % 8 == 5)  # quoted


def test_odd_tables(spark):
    rows, labels = corpus(160)
    rows += [(None, "moronic"), (500, None), (501, ""), (502, "moronic " * 20_000), (3, rows[3][1]), (3, rows[3][1])]
    lab = spark.createDataFrame([*labels, (0, 0), (None, 1), (700, 1), (4, None)], "doc_id bigint, toxic int")
    df = docs(spark, rows).withColumns({c: F.lit("x") for c in ("of", "y", "hits", "n_words", "word", "score", "l_of")})
    out = tx.score(df, lab, F.lit(True))
    got = out.collect()
    assert out.columns == ["doc_id", "score"] and len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert by[500] == by[501] and len(by[3]) == 1 and by[502].pop() > 0.5 and all(0 <= s <= 1 for v in by.values() for s in v)
    assert tx.score(df.limit(0), lab, F.lit(True)).count() == 0
    none = tx.score(df, lab.limit(0), F.lit(True)).agg(F.max("score")).first()[0]
    assert none < 0.01
    calm = tx.score(df, lab.withColumn("toxic", F.lit(0)), F.lit(True)).agg(F.max("score")).first()[0]
    assert calm < 0.5


def test_the_sample_is_bounded(spark):
    lab = spark.range(5_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    got = tx.sample_labels(lab, "doc_id", "toxic", F.lit(True), 300)
    assert 250 <= got.count() <= 300 and got.select("of").distinct().count() == got.count()
    assert tx.sample_labels(lab, "doc_id", "toxic", F.lit(True), 10_000).count() == 5_000
