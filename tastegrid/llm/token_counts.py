"""Token counts without ids: each distinct pre-token is counted once.

A sentencepiece BPE model never merges across the start of a run of its space mark, and never
across a line feed, if no piece of its vocabulary holds either inside.  Texts then fall into
pre-tokens whose token counts add up.  Each task turns a batch of documents into
postings (pre-token, and which documents of the batch hold it how often), packed by hash bucket of
the pre-tokens; the distinct pre-tokens of a bucket are counted by the library once each, joined to
the postings of the bucket, and the products summed per batch and document.

The commonest pre-tokens are in every batch, but a row of postings is one batch's bucket, so a
bucket has as many rows as there are batches; where its bytes stand out, Spark's adaptive skew join
splits them, as nothing above the join needs a bucket's rows together.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tastegrid.llm.common import documents, query

MODEL_NAME = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
MARK = "▁"
#: A batch of postings ends after so many documents or characters.
BATCH_DOCS, BATCH_CHARS = 16_384, 24_000_000
#: Entries that a task sums at once, and buckets of pre-tokens for each shuffle partition.
ENTRIES_HELD, BUCKETS_PER_PARTITION = 3_000_000, 32

_PRE_TOKEN = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
_HEAD = np.dtype([("has_id", "?"), ("id", "<i8"), ("n_bytes", "<i8")])
_POSTING, _SUM = ("bucket", "batch", "entries"), ("batch", "sums", "held")
_MODELS: dict = {}


def _model(blob: bytes):
    """The model of a task's process; refused if its pre-tokens could not be counted apart."""
    key = hashlib.md5(blob).digest()
    if key not in _MODELS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        check_separable(model)
        _MODELS.clear()
        _MODELS[key] = model
    return _MODELS[key]


def check_separable(model) -> None:
    """Raise unless texts may be cut before runs of the space mark and around line feeds."""
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
    inner = [p for p in pieces if MARK in p.lstrip(MARK) or "\n" in p]
    plain = model.normalize(" a  b\tﬁ\n") == f"{MARK}{MARK}a{MARK}{MARK}b\tﬁ\n"
    if inner or not plain:
        raise ValueError("this model's pieces cross pre-tokens or its normaliser rewrites texts")


def pre_tokens(text: str) -> list[str]:
    """``text`` as the model reads it (a space mark in front, one for each blank), cut where no piece crosses."""
    return _PRE_TOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


def count_pieces(model, tokens: list[str]) -> list[int]:
    """Number of pieces of each pre-token.  A line feed in front keeps the model's own space mark apart."""
    fixed = len(model.encode("\n"))
    return [len(ids) - fixed for ids in model.encode(["\n" + t for t in tokens], num_threads=1)]


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """(document numbers, texts) of bounded batches; null texts are empty."""
    ids, texts, size = [], [], 0
    for rb in rows:
        for d, t in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
            s = t.as_py() or ""
            ids.append(d)
            texts.append(s)
            size += len(s)
            if len(ids) >= BATCH_DOCS or size >= BATCH_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _number(texts: list[str]) -> tuple[dict[str, int], list[np.ndarray]]:
    """Numbers for the pre-tokens in the order in which they come, and each text as such numbers."""
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    get = number.__getitem__
    return number, [np.fromiter(map(get, pre_tokens(t)), np.int64) for t in texts]


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays behind their sizes, compressed."""
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    body = np.array([len(r) for r in raw], "<u8").tobytes() + b"".join(raw)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int) -> list[bytes]:
    body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    at, out = 8 * n, []
    for size in np.frombuffer(body, "<u8", n).tolist():
        out.append(body[at:at + size])
        at += size
    return out


def _spelled(tokens: list[str]) -> tuple[np.ndarray, bytes]:
    """Lengths in characters, and all characters together."""
    return np.fromiter(map(len, tokens), "<u4", len(tokens)), "".join(tokens).encode()


def _tokens(lengths: bytes, chars: bytes) -> list[str]:
    text, ends = chars.decode(), np.cumsum(np.frombuffer(lengths, "<u4").astype(np.int64)).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _by_bucket(tokens: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the tokens by bucket (a hash of the token), the buckets held and where each begins."""
    of = np.fromiter((crc32(t.encode()) for t in tokens), np.int64, len(tokens)) % buckets
    order = np.argsort(of, kind="stable")
    held, first = np.unique(of[order], return_index=True)
    return order, held, np.append(first, len(tokens))


def _distinct(rows: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, packed pre-tokens) of each batch."""
    for _, texts in _batches(rows):
        found: set[str] = set()
        for t in texts:
            found.update(pre_tokens(t))
        tokens = list(found)
        order, held, first = _by_bucket(tokens, buckets)
        tokens = [tokens[i] for i in order.tolist()]
        yield _rows(("bucket", "tokens"), held.astype(np.int32),
                    [_pack(*_spelled(tokens[a:b])) for a, b in zip(first, first[1:], strict=False)])


def _counted(rows: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket: (bucket, packed pre-tokens and pieces), each pre-token counted once."""
    def out(bucket: int, found: set[str]) -> pa.RecordBatch:
        tokens = list(found)
        pieces = np.array(count_pieces(model, tokens), "<u4")
        return _rows(("bucket", "pieces"), pa.array([bucket], pa.int32()), [_pack(*_spelled(tokens), pieces)])

    now, found = None, set()
    for rb in rows:
        for bucket, blob in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            if bucket != now:
                if found:
                    yield out(now, found)
                now, found = bucket, set()
            found.update(_tokens(*_unpack(blob, 2)))
    if found:
        yield out(now, found)


def _postings(rows: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, batch, packed pre-tokens with the documents that hold them); buckets under 0: what the batch holds."""
    part = TaskContext.get().partitionId()
    for k, (ids, texts) in enumerate(_batches(rows)):
        name = (part << 24) + k  # the same when the task runs again
        head = np.array([(d is not None, d or 0, len(t.encode())) for d, t in zip(ids, texts, strict=True)], _HEAD)
        yield _rows(_POSTING, pa.array([-1 - crc32(str(name).encode()) % buckets], pa.int32()), [name], [head.tobytes()])
        number, held = _number(texts)
        tokens = list(number)
        order, names, first = _by_bucket(tokens, buckets)
        rank = np.empty(len(tokens), np.int64)
        rank[order] = np.arange(len(tokens))
        doc = np.repeat(np.arange(len(texts)), [len(h) for h in held])
        pairs, times = np.unique(rank[np.concatenate(held)] * BATCH_DOCS + doc if tokens else doc, return_counts=True)
        of, doc = np.divmod(pairs, BATCH_DOCS)
        entries = np.searchsorted(of, np.arange(len(tokens) + 1))  # where each pre-token's entries begin
        tokens = [tokens[i] for i in order.tolist()]
        blobs = []
        for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
            cut = slice(entries[a], entries[b])
            blobs.append(_pack(*_spelled(tokens[a:b]), np.diff(entries[a:b + 1]).astype("<u2"),
                               np.diff(doc[cut], prepend=0).astype("<i2"), times[cut].astype("<u4")))
        yield _rows(_POSTING, names.astype(np.int32), np.full(len(names), name), blobs)


def _rows(names: tuple[str, ...], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _sums(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequency times pieces, summed per document of a batch: one row for each batch that a task has met.

    Also passes on what the batches hold.
    """
    slots, weights, held = [], [], 0

    def out() -> pa.RecordBatch:
        slot, which = np.unique(np.concatenate(slots), return_inverse=True)
        n = np.bincount(which, weights=np.concatenate(weights)).astype("<u8")
        batch, first = np.unique(slot >> 16, return_index=True)
        ends = np.append(first[1:], len(slot))
        packed = [_pack((slot[a:b] & 0xFFFF).astype("<u2"), n[a:b]) for a, b in zip(first, ends, strict=True)]
        return _rows(_SUM, batch, packed, pa.nulls(len(batch), pa.binary()))

    now, pieces = None, {}
    for rb in rows:
        for bucket, name, blob, counted in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            if bucket < 0:
                yield _rows(_SUM, [name], pa.nulls(1, pa.binary()), [blob])
                continue
            if bucket != now:
                *spelled, n = _unpack(counted, 3)
                now, pieces = bucket, dict(zip(_tokens(*spelled), np.frombuffer(n, "<u4").tolist(), strict=True))
            *spelled, size, doc, times = _unpack(blob, 5)
            n = np.array([pieces[t] for t in _tokens(*spelled)], np.float64)
            slots.append(name << 16 | np.cumsum(np.frombuffer(doc, "<i2").astype(np.int64)))
            weights.append(np.repeat(n, np.frombuffer(size, "<u2")) * np.frombuffer(times, "<u4"))
            held += len(slots[-1])
            if held >= ENTRIES_HELD:
                yield out()
                slots, weights, held = [], [], 0
    if held:
        yield out()


def _documents(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by batch: (doc_id, n_bytes, n_tokens) of the documents of each."""
    def out(head: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return _rows(("doc_id", "n_bytes", "n_tokens"), pa.array(head["id"], mask=~head["has_id"]),
                     head["n_bytes"].copy(), total[:len(head)])

    now = head = total = None
    for rb in rows:
        for name, sums, held in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            if name != now:
                if now is not None:
                    yield out(head, total)
                now, total = name, np.zeros(BATCH_DOCS, np.int64)
            if held is not None:
                head = np.frombuffer(held, _HEAD)
            else:
                place, n = _unpack(sums, 2)
                total[np.frombuffer(place, "<u2")] += np.frombuffer(n, "<u8").astype(np.int64)
    if now is not None:
        yield out(head, total)


def count_tokens(df: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id (long), n_bytes, n_tokens.

    Null and empty texts have 0 tokens.  Repeated rows and rows that share an id, null ids too, are
    counted each for itself.  Other columns are not carried.  An empty table gives an empty table.
    The rows of ``df`` must come in the same order when a task runs again, as those of a table do.
    """
    with open(model_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # the model: its size is fixed
    check_separable(_model(shared.value))
    docs = df.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))

    # one bucket is what a task holds of the vocabulary at once
    buckets = BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = (docs.mapInArrow(lambda rows: _distinct(rows, buckets), "bucket int, tokens binary")
              .repartition("bucket").sortWithinPartitions("bucket")
              .mapInArrow(lambda rows: _counted(rows, _model(shared.value)), "bucket int, pieces binary"))
    postings = docs.mapInArrow(lambda rows: _postings(rows, buckets), "bucket int, batch bigint, entries binary")
    joined = postings.join(pieces, "bucket", "left").select("bucket", "batch", "entries", "pieces")
    sums = joined.mapInArrow(_sums, "batch bigint, sums binary, held binary")
    return (sums.repartition("batch").sortWithinPartitions("batch")
            .mapInArrow(_documents, "doc_id bigint, n_bytes bigint, n_tokens bigint"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they are over the limit."""
    import public_tokenizers

    counts = count_tokens(documents(spark, sf_dir), public_tokenizers.path(MODEL_NAME))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
