import random

import public_tokenizers
import pytest
import sentencepiece

from tastegrid.llm import token_counts as tc

from .helpers import docs, prose

PATH = public_tokenizers.path(tc.MODEL_NAME)


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rnd = random.Random(5)
    odd = ["", None, " ", "   ", "a\n\nb", "▁a ▁", "<s> </s> <unk>", "日本 語\t1　x", "x" * 20_000, "the " * 5_000, "é\x00"]
    alphabet = " ▁\n\tabcthe.é日<s>/ 12\r"
    return odd + [prose(rnd, n) for n in (3, 3_000)] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
                                                       for _ in range(300)]


def test_counts_equal_the_library(spark, model):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in tc.count_tokens(docs(spark, rows), PATH).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert (got[i]["n_tokens"], got[i]["n_bytes"]) == (len(model.encode(t or "")), len((t or "").encode()))


def test_batches_and_sums_are_cut(spark, model, monkeypatch):
    rnd = random.Random(6)
    df = docs(spark, [(i, prose(rnd, 40)) for i in range(50)])
    monkeypatch.setattr(tc, "BATCH_CHARS", 500)  # tasks are forked processes or threads of this one
    batches = list(tc._batches(iter(df.select("doc_id", "text").toArrow().to_batches())))
    assert len(batches) > 3 and sum(len(ids) for ids, _ in batches) == 50


def test_edges(spark, model):
    assert tc.count_tokens(docs(spark, []), PATH).count() == 0
    df = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (1, "c", 7), (None, "d e f", 7), (None, None, 7)],
                               "doc_id bigint, text string, n_tokens int")
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in tc.count_tokens(df, PATH).collect())
    n = lambda t: len(model.encode(t))
    assert got == sorted([(1, n("a b")), (1, n("a b")), (1, n("c")), (-1, n("d e f")), (-1, 0)])


def test_other_models_are_refused():
    class Crossing:
        def vocab_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

        def normalize(self, t):
            return t

    with pytest.raises(ValueError):
        tc.check_separable(Crossing())
