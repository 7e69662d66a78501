"""Quality rules as weak supervision (DataFrame functions only).

Each rule looks at one measure of a text and votes good, votes bad or abstains.  Texts are good or of one of
several kinds of bad ones; expectation maximisation over the vote patterns of the whole corpus estimates the shares
of these classes and how often each rule votes what on each.  Every text then gets the posterior probability of
being good, which replaces passing all rules at once.

A bad vote alone cannot tell a kind of bad texts from good texts on which the rule errs.  So a kind counts only if a
second rule votes bad on it more often than on good texts, and if the votes are likelier with it than without by more
than its parameters cost (Bayesian information criterion); else its texts fall to the other classes, and the
rule's error rate on good texts rises.

Only the counts by vote pattern leave the executors: at most 3 ** len(RULES) rows at any
corpus size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tastegrid.llm.common import SPACE, documents, query, saved, shielded, text_or_empty, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
EM_ROUNDS = 50
#: Where the estimation starts: shares of bad votes on good texts, and on a kind by the rule that it starts from and
#: by the others.
START_GOOD, START_OWN, START_OTHER = 0.005, 0.6, 0.1
#: Weight of the starting values in the estimates, in texts a class; it does not grow with the corpus.
PSEUDO_TEXTS = 5.0
START_SHARE_GOOD = 0.8
#: Least excess over good texts of the second rule's share of bad votes in a kind.
MIN_BACKING = 0.1
#: Least posterior probability of a kept text: both errors cost the same.
THRESHOLD = 0.5


class Vote(NamedTuple):
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains (0)."""
    name: str
    good: str
    bad: str


RULES = (
    Vote("symbols", "n_symbols <= 0.05 * n_words", "n_symbols > 0.10 * n_words"),
    Vote("repeated_words", "n_repeat_words <= 0.10 * n_words", "n_repeat_words > 0.20 * n_words"),
    Vote("repeated_lines", "n_dup_lines <= 0.10 * n_lines AND n_lines > 2", "n_dup_lines > 0.40 * n_lines"),
    Vote("upper_case", "n_upper <= 0.10 * word_chars", "n_upper > 0.30 * word_chars"),
    Vote("shouting", "n_exclaim <= 0.02 * n_words", "n_exclaim > 0.10 * n_words"),
    Vote("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words",
         "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Vote("line_ends", "n_ended_lines >= 0.90 * n_lines", "n_ended_lines < 0.30 * n_lines AND n_words >= 50"),
    Vote("vocabulary", "n_distinct_words >= 0.50 * n_words", "n_distinct_words < 0.20 * n_words AND n_words < 2000"),
    Vote("not_words", "n_not_words <= 0.05 * n_words", "n_not_words > 0.30 * n_words"),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines",
            "n_upper", "n_exclaim", "n_distinct_words", "n_not_words")


@shielded("text")
def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns of ``MEASURES`` (long); columns of these names are replaced.

    Null texts are read as empty and give 0 everywhere.
    """
    df = df.drop(*MEASURES)
    t, w, h = F.col("_t"), F.col("_w"), F.col("_h")
    n = F.size("_w")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    removed = lambda cls: F.length(t) - F.length(F.regexp_replace(t, cls, ""))
    step = df.withColumn("_t", text_or_empty(text)).withColumns({"_w": words(t), "_l": lines})
    step = step.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": removed(r"[#*$%&|<>]+").cast("long"),
        "n_upper": removed(r"[A-Z]+").cast("long"),
        "n_exclaim": (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_ended_lines": F.size(F.filter("_l", lambda x: x.rlike(r"[.!?:;]" + SPACE + "*$"))).cast("long"),
        "n_distinct_words": F.size(F.array_distinct("_w")).cast("long"),
        "n_not_words": F.size(F.filter("_w", lambda x: ~x.rlike(r"\p{L}"))).cast("long"),
        # one hash for each window of five words
        "_h": F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)),
                                             lambda i: F.xxhash64(F.slice(w, i, WINDOW)))),
    }).drop("_t", "_w", "_l")
    # only texts with some repeated window go on to find where: (hash, place) sorted, equal neighbours marked
    step = step.withColumn("_p", F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("_h")
    p = F.col("_p")
    step = step.withColumn("_e", F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))),
                                            lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    e = F.col("_e")
    before = F.slice(F.concat(F.array(F.lit(False)), e), 1, F.greatest(F.size(e), F.lit(1)))
    marked = F.zip_with(F.zip_with(e, before, lambda x, y: x | y), p, lambda f, q: F.when(f, q["i"]))
    step = step.withColumn("_i", F.array_sort(F.array_compact(marked))).drop("_p", "_e")
    i = F.col("_i")
    # the words that the marked windows cover: each reaches five words on, or to the next marked one
    reach = F.zip_with(i, F.slice(i, 2, F.greatest(F.size(i), F.lit(1))),
                       lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda s, x: s + x)
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_i")


def vote(rule: Vote) -> Column:
    """1 good, -1 bad, 0 abstains."""
    return F.expr(f"CASE WHEN {rule.bad} THEN -1 WHEN {rule.good} THEN 1 ELSE 0 END")


class Model(NamedTuple):
    share_good: float
    good: list[float]  # per rule: P(it votes bad | good text, it votes)
    bad: list[float]  # the same for bad texts of all kinds together
    shares: np.ndarray  # of the classes; the first is good
    outcomes: np.ndarray  # class, rule: probabilities of a bad vote, abstaining, a good vote


def log_odds(model: Model) -> tuple[float, list[dict[int, float]]]:
    """Log prior odds of good, and for each rule what its vote adds if nothing else is known; abstaining adds nothing."""
    adds = [{1: math.log((1 - g) / (1 - b)), -1: math.log(g / b), 0: 0.0}
            for g, b in zip(model.good, model.bad, strict=True)]
    return math.log(model.share_good / (1 - model.share_good)), adds


def _em(is_vote: np.ndarray, n: np.ndarray, shares: np.ndarray, outcomes: np.ndarray,
        rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Shares, outcomes and log likelihood after the rounds, from the given ones on."""
    flat = is_vote.reshape(len(n), 3 * is_vote.shape[1])
    start_shares, start, fit_to = shares, outcomes, -math.inf
    for last in [False] * rounds + [True]:
        z = np.log(shares) + flat @ np.log(outcomes).reshape(len(shares), -1).T
        top = z.max(axis=1, keepdims=True)
        of = np.exp(z - top)
        total = of.sum(axis=1, keepdims=True)
        if last:
            fit_to = float(n @ (top + np.log(total))[:, 0])
            break
        mass = of / total * n[:, None]
        shares = mass.sum(axis=0) + PSEUDO_TEXTS * start_shares
        shares = shares / shares.sum()
        outcomes = (mass.T @ flat).reshape(outcomes.shape) + PSEUDO_TEXTS * start
        outcomes = outcomes / outcomes.sum(axis=2, keepdims=True)
    return shares, outcomes, fit_to


def fit(patterns: Sequence[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> Model:
    """Classes from (votes, number of texts) rows; without rows the starting values come back.

    There is a kind of bad texts for each rule at first; those that nothing backs are left out one by one.
    """
    n_rules = len(patterns[0][0]) if patterns else len(RULES)
    rows = sorted(patterns)
    votes = np.array([v for v, _ in rows]).reshape(-1, n_rules)
    n = np.array([k for _, k in rows], float)
    is_vote = np.stack([votes == -1, votes == 0, votes == 1], axis=-1).astype(float)
    # rules abstain alike on all classes at first
    silent = np.clip(n @ is_vote[:, :, 1] / max(1.0, n.sum()), 0.001, 0.9)

    def start(bad: np.ndarray) -> np.ndarray:
        return np.stack([bad * (1 - silent), silent, (1 - bad) * (1 - silent)], axis=-1)

    good = start(np.full(n_rules, START_GOOD))
    kinds = [start(np.where(np.arange(n_rules) == j, START_OWN, START_OTHER)) for j in range(n_rules)]
    parameters = 1 + sum(1 + bool(is_vote[:, j, 1].any()) for j in range(n_rules))

    def model(alive: list[int]) -> tuple[Model, np.ndarray, float]:
        """Also how much the second rule backs each kind, and the information criterion."""
        shares = np.array([START_SHARE_GOOD] + [(1 - START_SHARE_GOOD) / max(1, len(alive))] * len(alive))
        shares, outcomes, fit_to = _em(is_vote, n, shares / shares.sum(), np.array([good] + [kinds[k] for k in alive]),
                                       rounds if len(rows) else 0)
        bad = outcomes[:, :, 0] / (1 - outcomes[:, :, 1])
        backing = np.sort(bad[1:] - bad[0], axis=1)[:, -2] if n_rules > 1 else np.full(len(alive), -math.inf)
        both = np.tensordot(shares[1:], outcomes[1:], axes=1) if alive else start(np.full(n_rules, START_OTHER))
        return (Model(float(shares[0]), bad[0].tolist(), (both[:, 0] / (both[:, 0] + both[:, 2])).tolist(), shares, outcomes),
                backing, fit_to - 0.5 * math.log(max(1.0, n.sum())) * parameters * len(alive))

    alive = list(range(n_rules))
    now = model(alive)
    while alive and len(rows):
        weakest = int(now[1].argmin())
        if now[1][weakest] < MIN_BACKING:
            alive.pop(weakest)
            now = model(alive)
            continue
        without = [model(alive[:k] + alive[k + 1:]) for k in range(len(alive))]
        k = max(range(len(alive)), key=lambda i: without[i][2])
        if without[k][2] < now[2]:
            break
        alive.pop(k)
        now = without[k]
    return now[0]


def score(model: Model, rules: Sequence[Vote] = RULES) -> Column:
    """Posterior probability of good from the vote columns ``vote_<name>``.

    Abstaining tells classes apart on texts with some bad vote; it is no vote against a text by itself.
    """
    cast = [F.col(f"vote_{r.name}") for r in rules]
    objected = reduce(lambda a, b: a | b, [v == -1 for v in cast])
    odds = F.lit(1.0)
    for share, outcomes in zip(model.shares[1:], model.outcomes[1:], strict=True):
        z = F.lit(math.log(share / model.shares[0]))
        for v, (bad, silent, good) in zip(cast, np.log(outcomes / model.outcomes[0]).tolist(), strict=True):
            z = z + F.when(v == 1, F.lit(good)).when(v == -1, F.lit(bad)).when(objected, F.lit(silent)).otherwise(F.lit(0.0))
        odds = odds + F.exp(F.least(z, F.lit(700.0)))
    return F.lit(1.0) / odds


def _voted(measured: DataFrame, rules: Sequence[Vote]) -> DataFrame:
    """Rows with the columns of ``MEASURES``, plus ``vote_<rule>`` and ``base_failed``."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    return (measured.drop("base_failed", "posterior", "kept", *[f"vote_{r.name}" for r in rules])
            .withColumns({f"vote_{r.name}": vote(r) for r in rules}).withColumn("base_failed", base_failed))


def judge_measured(counted: DataFrame, rows: DataFrame, rules: Sequence[Vote] = RULES,
                   threshold: float = THRESHOLD) -> DataFrame:
    """``rows`` with the votes, ``posterior`` and ``kept``; the rules' accuracies come from ``counted``.

    Both have the columns of ``MEASURES``, of the same texts.
    """
    names = [f"vote_{r.name}" for r in rules]
    counts = _voted(counted, rules).groupBy(*names).count().collect()
    model = fit([(tuple(r[n] for n in names), r["count"]) for r in counts])
    return (_voted(rows, rules).withColumn("posterior", score(model, rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)))


@shielded("text")
def judge(df: DataFrame, text: str = "text", rules: Sequence[Vote] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with the measures, ``vote_<rule>``, ``base_failed``, ``posterior`` and ``kept``.

    Every row counts, repeated ones as often as they occur, and stays.  Null and empty texts have no
    words, so ``base_failed`` is true and ``kept`` false.  Columns of the added names are replaced.
    An empty table gives an empty table.  The texts are measured once and written with the measures,
    which both the estimation and the verdicts read.
    """
    rows = saved(measures(df, text))
    return judge_measured(rows, rows, rules, threshold)


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, posterior and verdict of every document."""
    # read twice; kept as blocks of the tasks' machines, not as two more files a partition in the shared folder
    measured = measures(documents(spark, sf_dir).select("doc_id", "text")).drop("text").persist(StorageLevel.DISK_ONLY)
    return judge_measured(measured, measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "posterior")
