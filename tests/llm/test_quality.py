import collections
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tastegrid.llm import quality as q
from tastegrid.session import ensure_checkpoint_dir

from .helpers import docs, prose

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = collections.Counter(windows)
    covered = set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures(spark):
    rnd = random.Random(2)
    texts = ["", None, " \t\n", "a", "a b c d e", "x " * 9, "a b c d e f a b c d e", "one\none\n \n \nTwo words\x0bx\x0cy\rz",
             "#*$%&|<> é", "ab " * 20_000, prose(rnd, 20_000)] + [
        " ".join(rnd.choice("abc") + rnd.choice(["", "\n", "|"]) for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    got = q.measures(docs(spark, list(enumerate(texts)))).collect()
    for r in got:
        want = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want


def test_em_finds_accuracies():
    rnd = random.Random(1)
    rows = collections.Counter()
    for _ in range(20_000):
        good = rnd.random() < 0.85
        kind = rnd.randrange(4)  # bad texts are of four kinds; each rule knows one and guesses at the others
        rows[tuple(-1 if rnd.random() < (0.003 if good else 0.9 if kind == j else 0.1) else 1 for j in range(4))] += 1
    model = q.fit(list(rows.items()))
    base, adds = q.log_odds(model)
    assert 0.8 < model.share_good < 0.9
    assert all(a[-1] < -2.5 and a[1] > 0 == a[0] for a in adds)
    # votes decide together what each alone leaves open
    score = lambda *v: base + sum(a[x] for a, x in zip(adds, v))
    assert score(1, 1, 1, 1) > 2 and score(-1, -1, 1, 1) < -2
    assert q.fit([]).share_good == q.START_SHARE_GOOD


def test_edges(spark):
    assert q.judge(docs(spark, [])).count() == 0
    df = spark.createDataFrame([(1, "a b", "x"), (None, None, "y"), (1, "a b", "x")], "doc_id bigint, text string, kept string")
    rows = q.judge(df).collect()
    assert len(rows) == 3 and all(r["base_failed"] and not r["kept"] for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_labels_are_met(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = q.op4_quality_rules(spark, SF).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / max(1, len(bad)) < 0.2


def noisy(rnd, errs):
    """Votes of six rules: two kinds of bad texts that two rules each see; rule 4 errs on the share ``errs`` of good texts."""
    rows = collections.Counter()
    for _ in range(20_000):
        kind = 0 if rnd.random() < 0.85 else rnd.choice((1, 2))
        rates = {0: [0.003] * 4 + [errs, 0.003], 1: [0.95, 0.6, 0.003, 0.003, errs, 0.003], 2: [0.003, 0.003, 0.95, 0.6, errs, 0.003]}[kind]
        rows[tuple(-1 if rnd.random() < p else 1 for p in rates)] += 1
    return list(rows.items())


def posterior(spark, model, votes):
    rules = [q.Vote(f"r{j}", "", "") for j in range(len(votes))]
    row = spark.range(1).select(*[F.lit(v).alias(f"vote_r{j}") for j, v in enumerate(votes)])
    return row.select(q.score(model, rules).alias("p")).first()["p"]


def test_a_rule_that_errs_does_not_reject_alone(spark):
    for errs in (0.1, 0.2):
        model = q.fit(noisy(random.Random(3), errs))
        assert errs - 0.02 < model.good[4] < errs + 0.02 and 0.82 < model.share_good < 0.88
        assert posterior(spark, model, (1, 1, 1, 1, 1, 1)) > 0.9
        assert posterior(spark, model, (1, 1, 1, 1, -1, 1)) > q.THRESHOLD
        assert posterior(spark, model, (-1, -1, 1, 1, 1, 1)) < 0.1 and posterior(spark, model, (1, 1, -1, -1, -1, 1)) < 0.1
        # the better rule of a kind needs no other
        assert posterior(spark, model, (-1, 1, 1, 1, 1, 1)) < q.THRESHOLD


def test_estimates_do_not_depend_on_the_weight_of_the_start():
    rows = noisy(random.Random(4), 0.1)
    small, large = q.fit(rows), q.fit([(v, 50 * n) for v, n in rows])
    assert max(abs(a - b) for a, b in zip(small.good, large.good)) < 0.01


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_texts_on_which_one_rule_errs_stay(spark):
    """Word length votes bad on 10 % of the texts to which no rule objects."""
    rules = [r._replace(bad=f"({r.bad}) OR errs") if r.name == "word_length" else r for r in q.RULES]
    errs = (F.pmod("doc_id", F.lit(10)) == 0) & (F.col("n_symbols") <= 0.05 * F.col("n_words")) & (F.col("n_repeat_words") == 0)
    measured = q.measures(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")).withColumn("errs", errs).cache()
    rows = q.judge_measured(measured, measured, rules).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("NOT base_failed")
    rows = rows.where("quality = 1 AND errs AND vote_word_length = -1").collect()
    assert len(rows) > 10 and sum(r["kept"] for r in rows) > 0.95 * len(rows)


def test_texts_are_measured_once(spark):
    """The verdicts are read from written measures; the plan has no measure of a text in it."""
    rnd = random.Random(5)
    out = q.judge(docs(spark, [(i, prose(rnd, 60)) for i in range(20)]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan and "regexp_replace" not in plan and "xxhash64" not in plan
    assert out.count() == 20


def test_measures_leave_no_files_in_the_shared_folder(spark, tmp_path):
    """They are read twice, from kept blocks: texts are measured once, and no partition writes files but the result's."""
    rnd = random.Random(6)
    docs(spark, [(i, prose(rnd, 60)) for i in range(20)]).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = q.op4_quality_rules(spark, str(tmp_path))
    assert out.count() == 20 and set(os.listdir(folder)) == before
    plan = out._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan and "xxhash64" not in plan.split("InMemoryRelation")[0]
