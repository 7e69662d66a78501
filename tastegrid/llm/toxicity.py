"""Toxicity by fuzzy lexicon hits in their contexts.

A lexicon of terms is learned from labelled texts.  Its terms form a trie, and the Levenshtein automata of all terms
at once are intersected with it: a state is a set of (trie node, edits spent), a character advances it by match,
substitution, insertion or deletion, and a word is a hit if it ends in a state that holds a term within the term's edits.
The product automaton is made deterministic lazily, so a word costs one table look-up a character and most die after a few.

A hit counts with its term's log odds, fewer the more edits it took, and with the score of its context: the words
within ``CONTEXT`` places on each side, whose log odds are learned from hits in toxic and in other labelled texts, and whether the
hit stands in quotation marks.  A logistic regression on sums over a text's hits gives the score.

Labelled rows are used up to a documented bound, ``TRAIN_ROWS``, picked by a hash of the id; so the labels that travel to the texts are
bounded and no text is shuffled.  A term is supported by the different words that it follows, not by how many texts hold
it: thousands of copies of one toxic text add one place for each of their words.  The terms, contexts and
weights are bounded by parameters; all that is collected is one of these.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tastegrid.llm.common import documents, query, saved, text_or_empty
from tastegrid.sources.tables import read_table

#: Labelled rows that are learned from, terms of the lexicon, words that may have weight as context, known clean look-alikes.
TRAIN_ROWS, TERMS, CONTEXT_TERMS, LOOKALIKES = 100_000, 2_000, 2_000, 20_000
#: Words on each side that make a hit's context; a held-out fold of the labels.
CONTEXT, FOLDS = 5, 5
#: A term follows this many different words in toxic texts, is this much likelier there (log), by this many standard errors.
MIN_PLACES, MIN_LOG_ODDS, MIN_SIGMA = 3, 1.0, 2.5
#: Edits that a term of at least so many characters may take, and what a hit's weight is multiplied by for each.
EDITS, EDIT_FACTOR = ((0, 0), (5, 1), (9, 2)), 0.5
#: Weight of the overall odds in a context word's.
CONTEXT_PRIOR = 10.0
#: Deterministic states that a worker keeps, and words of one count table before it is passed on.
STATES, HELD = 200_000, 200_000

_WORD = re.compile(r"[^\W_]+")
_QUOTED = re.compile("\"[^\"\n]*\"|«[^»\n]*»|“[^”\n]*”|„[^“”\n]*[“”]|‹[^›\n]*›")
FEATURES = ("bias", "plain", "fuzzy", "quoted", "terms", "share", "context")
RISING = (1, 2, 4, 5)


def edits_of(term: str) -> int:
    """Edits that a hit of ``term`` may take."""
    return max(e for n, e in EDITS if len(term) >= n)


class FuzzyLexicon:
    """Trie of terms with the product of their Levenshtein automata, made deterministic as words ask for it."""

    def __init__(self, terms: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.limit: list[int] = []
        self.room = [0]  # most edits of the terms below a node
        for number, word in enumerate(terms):
            limit, node = edits_of(word), 0
            self.limit.append(limit)
            self.room[0] = max(self.room[0], limit)
            for ch in word:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.room.append(0)
                node = nxt
                self.room[node] = max(self.room[node], limit)
            self.term[node] = number
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.ends: list[tuple[int, int] | None] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _close(self, nodes: dict[int, int]) -> dict[int, int]:
        """Adds what deletions reach: a term's character that the word lacks."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            spent = nodes[node] + 1
            for child in self.children[node].values():
                if spent <= self.room[child] and spent < nodes.get(child, 99):
                    nodes[child] = spent
                    todo.append(child)
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        nodes = self._close(nodes)
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(nodes)
            found = [(e, self.term[n]) for n, e in nodes.items() if self.term[n] >= 0 and e <= self.limit[self.term[n]]]
            self.ends.append(min(found) if found else None)
            self.moves.append({})
        return self.states[key]

    def _move(self, state: int, ch: str) -> int:
        out: dict[int, int] = {}

        def put(node: int, spent: int) -> None:
            if spent <= self.room[node] and spent < out.get(node, 99):
                out[node] = spent

        for node, spent in self.sets[state].items():
            put(node, spent + 1)  # insertion
            for c, child in self.children[node].items():
                put(child, spent + (c != ch))
        return self._state(out) if out else -1

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the closest term within its edits, the first of equals; None without one."""
        if len(self.sets) > STATES:
            self._forget()
        state = self.start
        for ch in word:
            nxt = self.moves[state].get(ch)
            if nxt is None:
                nxt = self.moves[state][ch] = self._move(state, ch)
            if nxt < 0:
                return None
            state = nxt
        return self.ends[state]


def tokens(text: str) -> list[re.Match]:
    """The words of a text in lower case, with their places: runs of letters and digits."""
    return list(_WORD.finditer(text))


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def text_hits(text: str, lexicon: FuzzyLexicon, clean: frozenset, memo: dict) -> tuple[int, list[tuple]]:
    """(number of words, hits) of a text; a hit is (term, edits, quoted, context words)."""
    found = tokens(_lower(text))
    words = [m.group() for m in found]
    hits, quotes = [], None
    for i, w in enumerate(words):
        hit = memo.get(w, 0)
        if hit == 0:
            hit = lexicon.find(w)
            if hit is not None and hit[0] and w in clean:
                hit = None
            if len(memo) > HELD:
                memo.clear()
            memo[w] = hit
        if hit is None:
            continue
        if quotes is None:
            quotes = [(m.start(), m.end()) for m in _QUOTED.finditer(text)]
        at = bisect.bisect_right(quotes, (found[i].start(), math.inf)) - 1
        inside = at >= 0 and found[i].start() < quotes[at][1]
        hits.append((hit[1], hit[0], inside, words[max(0, i - CONTEXT):i] + words[i + 1:i + 1 + CONTEXT]))
    return len(words), hits


def features(n_words: int, hits: list, weights, context: dict) -> list[float]:
    """The sums that the regression reads (``FEATURES``)."""
    plain = fuzzy = quoted = around = 0.0
    for h in hits:
        w = weights[h[0]] * EDIT_FACTOR ** h[1]
        if h[2]:
            quoted += w
        elif h[1]:
            fuzzy += w
        else:
            plain += w
        known = [context[c] for c in h[3] if c in context]
        around += sum(known) / len(known) if known else 0.0
    n = max(1, len(hits))
    return [1.0, math.log1p(plain), math.log1p(fuzzy), math.log1p(quoted), math.log1p(len({h[0] for h in hits})),
            math.log1p(100.0 * len(hits) / max(1, n_words)), around / n]


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method, rows counted ``times``; the bias is hardly shrunk.

    Hits outside quotation never speak for a text: a feature of ``RISING`` with a negative weight is left out and the rest fitted again.
    """
    used = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        if not times.sum():
            w[0] = -30.0  # nothing to learn from
            return w
        z, shrink = x[:, used], np.where(np.arange(used.sum()) == 0, 1e-3, ridge)
        v = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
            step = np.linalg.solve((z * (times * p * (1 - p))[:, None]).T @ z + np.diag(shrink), z.T @ (times * (p - y)) + shrink * v)
            v -= step
            if np.abs(step).max() < 1e-8:
                break
        w[used] = v
        against = [i for i in RISING if w[i] < 0]
        if not against:
            return w
        used[min(against, key=lambda i: w[i])] = False


def sample_labels(labels: DataFrame, doc_id: str, toxic: str, train: Column, bound: int) -> DataFrame:
    """(of, y) of at most ``bound`` labelled documents for training, by a hash of the id; one row a document."""
    one = labels.where(train & F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("of")).agg(
        F.max(F.col(toxic).cast("int")).alias("y"))
    place = F.pmod(F.xxhash64("of"), F.lit(1 << 30))
    n = one.count()
    if n > bound:  # about ``bound`` rows are left to be ordered
        one = one.where(place < int((1 << 30) * min(1.0, 1.02 * bound / n)))
    return one.orderBy(place, "of").limit(bound)


def _pairs(counts: Counter) -> pa.RecordBatch:
    words = [k[0] for k in counts]
    return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "before": pa.array([k[1] for k in counts], pa.string()),
                                       "n": pa.array(list(counts.values()), pa.int64())})


def _places(toxic_texts: DataFrame) -> DataFrame:
    """(word, before, n): in how many of the texts a word follows another; before is null for in how many it is at all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                words = [m.group() for m in tokens(_lower(t.as_py()))]
                counts.update({(w, None) for w in words})
                counts.update(set(zip(words, ["", *words], strict=False)))
                if len(counts) > HELD:
                    yield _pairs(counts)
                    counts.clear()
        if counts:
            yield _pairs(counts)
    return toxic_texts.mapInArrow(run, "word string, before string, n bigint")


def _counted(texts: DataFrame, wanted) -> DataFrame:
    """(word, n): in how many texts each word that ``wanted`` accepts occurs; ``wanted`` is made in the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept, counts, memo = wanted(), Counter(), {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

        for b in batches:
            for t in b.column(0):
                for w in {m.group() for m in tokens(_lower(t.as_py()))}:
                    ok = memo.get(w)
                    if ok is None:
                        if len(memo) > HELD:
                            memo.clear()
                        ok = memo[w] = accept(w)
                    if ok:
                        counts[w] += 1
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        if counts:
            yield out()
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def learn_terms(train: DataFrame) -> tuple[list[tuple[str, float]], frozenset]:
    """((term, weight), ...) and clean look-alikes from ``train`` (text, y): words likelier in toxic texts than in others."""
    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    toxic, other = n.get(1, 0), n.get(0, 0)
    if not toxic:
        return [], frozenset()
    by_place = _places(train.where("y = 1").select("text")).groupBy("word", "before").agg(F.sum("n").alias("n"))
    support = by_place.groupBy("word").agg(F.sum(F.when(F.col("before").isNull(), F.col("n"))).alias("df"),
                                           F.count("before").alias("places"))
    # copies of a text add no places; ten times the terms are looked up in the other texts
    effective = F.least("df", "places")
    candidates = (support.where(F.col("places") >= MIN_PLACES).select("word", effective.alias("a"))
                  .where(F.col("a") >= MIN_PLACES).orderBy(F.desc("a"), "word").limit(10 * TERMS).collect())
    a = {r["word"]: r["a"] for r in candidates}
    words = frozenset(a)
    b = {r["word"]: r["n"] for r in _counted(train.where("y = 0").select("text"), lambda: words.__contains__).collect()}  # candidates
    scored = []
    for w, x in a.items():
        y = b.get(w, 0)
        odds = math.log((x + 0.5) / (toxic + 1)) - math.log((y + 0.5) / (other + 1))
        if odds >= MIN_LOG_ODDS and odds >= MIN_SIGMA * (error := math.sqrt(1 / (x + 0.5) + 1 / (y + 0.5))):
            scored.append((w, odds, odds / error))
    scored.sort(key=lambda t: (-t[2], t[0]))
    terms = [(w, odds) for w, odds, _ in scored[:TERMS]]
    names = tuple(w for w, _ in terms)

    def near():
        lexicon = FuzzyLexicon(names)
        return lambda w: (hit := lexicon.find(w)) is not None and hit[0] > 0

    clean = (_counted(train.where("y = 0").select("text"), near).orderBy(F.desc("n"), "word").limit(LOOKALIKES).collect())
    return terms, frozenset(r["word"] for r in clean)


_HITS = "array<struct<term:int,edits:int,quoted:boolean,context:array<string>>>"


def find_hits(docs: DataFrame, terms: tuple[str, ...], clean: frozenset) -> DataFrame:
    """``docs`` (of, text) without text, with n_words and hits."""
    kind = pa.list_(pa.struct([("term", pa.int32()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("context", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, memo = FuzzyLexicon(terms), {}
        for b in batches:
            sizes, found = [], []
            for t in b.column(1):
                n, hits = text_hits(t.as_py(), lexicon, clean, memo)
                sizes.append(n)
                found.append([{"term": h[0], "edits": h[1], "quoted": h[2], "context": h[3]} for h in hits])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(found, kind)], names=["of", "n_words", "hits"])
    return docs.mapInArrow(run, f"of bigint, n_words bigint, hits {_HITS}")


def learn_contexts(hits: DataFrame) -> dict[str, float]:
    """{word: log odds over all hits' odds} from labelled ``hits`` (y, hits): the words around hits in toxic and other texts."""
    around = hits.select("y", F.explode("hits").alias("h")).select("y", F.explode(F.array_distinct("h.context")).alias("word"))
    counts = around.groupBy("word").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
    rows = counts.where("n >= 5").orderBy(F.desc("n"), "word").limit(CONTEXT_TERMS).collect()
    total = sum(r["n"] for r in rows)
    if not total:
        return {}
    p = min(0.99, max(0.01, sum(r["a"] for r in rows) / total))
    logit = lambda q: math.log(q / (1 - q))
    return {r["word"]: logit(min(0.999, max(0.001, (r["a"] + CONTEXT_PRIOR * p) / (r["n"] + CONTEXT_PRIOR)))) - logit(p) for r in rows}


def _scored(hits: DataFrame, weights: tuple[float, ...], context: dict, fit) -> DataFrame:
    """(of, score) or, without ``fit``, (y, x) with the regression's inputs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.empty((b.num_rows, len(FEATURES)))
            for i, (n, found) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                x[i] = features(n or 0, [(h["term"], h["edits"], h["quoted"], h["context"]) for h in found or ()], weights, context)
            if fit is None:
                yield pa.RecordBatch.from_pydict({"y": b.column(0).cast(pa.int64()), "x": pa.array(list(x), pa.list_(pa.float64()))})
            else:
                score = 1 / (1 + np.exp(-np.clip(x @ np.array(fit), -30, 30)))
                yield pa.RecordBatch.from_pydict({"of": b.column(0), "score": pa.array(score)})
    first = "y" if fit is None else "of"
    return hits.select(first, "n_words", "hits").mapInArrow(run, "y bigint, x array<double>" if fit is None else "of bigint, score double")


def score(docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
          train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score), one row for each row of ``docs``; score is the probability that the text is toxic.

    ``train`` is a condition on the rows of ``labels``; only labels that it picks are learned from, at most
    ``train_rows`` documents of them.  Scores read nothing but the text.  Of several labels of a document the greatest counts; null labels,
    labels of unknown documents and null ids are ignored.  Null texts are empty; texts without hits all get the same
    score.  Where labels name no toxic text, all scores are next to 0; without labels they are 0 but for rounding.  Repeated rows are scored alike; columns that are
    not named are not read.  An empty table gives an empty table.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("of"), text_or_empty(text).alias("text"))
    picked = F.broadcast(saved(sample_labels(labels, doc_id, toxic, train, train_rows)))  # ``train_rows`` at most
    of = lambda rows: rows.join(picked.withColumnRenamed("of", "l_of"), F.col("of") == F.col("l_of")).drop("l_of")
    terms, clean = learn_terms(of(base).select("text", "y"))
    names, weights = tuple(w for w, _ in terms), tuple(x for _, x in terms)
    hits = saved(find_hits(base, names, clean))
    known = of(hits)
    context = learn_contexts(known)
    # texts without hits are alike to the regression: they go as counts
    bare = {r["y"]: r["n"] for r in known.where(F.size("hits") == 0).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    rows = _scored(known.where(F.size("hits") > 0).limit(train_rows), weights, context, None).collect()
    empty = features(0, [], weights, context)
    x = np.array([r["x"] for r in rows] + [empty, empty])
    y = np.array([r["y"] for r in rows] + [0, 1], float)
    fit = logistic(x, y, np.array([1.0] * len(rows) + [bare.get(0, 0), bare.get(1, 0)]))
    return _scored(hits, weights, context, tuple(fit)).select(F.col("of").alias(doc_id), "score")


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; the fold whose checksum the number of folds divides is held out of the learning."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    out = score(documents(spark, sf_dir).select("doc_id", "text"), read_table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
