"""Byte-level BPE encoding and decoding with the tokenizers library.

The vocabulary is a rank file (base64 token, rank).  Its tokens are byte strings; the library
works on characters, so each byte is written as one printable character (the byte table) and the
merges are rebuilt from the ranks.  Texts are split by the pattern, each distinct match of an Arrow
batch is encoded once, and the ids of a text are put together from its matches.  Decoding maps
ids back to characters and these to bytes; characters whose bytes lie in several tokens come out
whole, as bytes are joined before they are read as UTF-8.
"""

from __future__ import annotations

import base64
import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tastegrid.llm.common import documents, query

RANKS_NAME = "byte_bpe_50k.tiktoken"
#: Distinct matches whose ids a task keeps at most; beyond it the memory is emptied and filled anew.
MEMORY_ENTRIES = 200_000
#: Text characters (in decoding: tokens) handled and returned at once within an Arrow batch.
SLICE_CHARS = 1_000_000


def byte_table() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    own = set(printable)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def merge_parts(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens that the merges of lower rank leave of ``token``."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        options = [(ranks[pair], i) for i in range(len(parts) - 1)
                   if ranks.get(pair := parts[i] + parts[i + 1], rank) < rank]
        if not options:
            raise ValueError(f"no merges lead to token {token!r}")
        i = min(options)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """A tokenizers model with the merges of a rank file; it encodes one match of the pattern at a time."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    table = byte_table()
    spell = lambda token: "".join(table[b] for b in token)
    merges = [tuple(map(spell, merge_parts(t, r, ranks)))
              for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
    model = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges))
    model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return model.to_str()


_LOADED: dict = {}


class Encoder:
    """Encodes texts in a task; the tokenizer and the ids of known matches are kept between batches."""

    def __init__(self, spec: str, pattern: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(spec)
        self.find = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()  # of each match met
        self.number.default_factory = self.number.__len__
        self.ids = np.empty(0, "<u4")  # of all matches, one after the other
        self.ends = np.zeros(1, np.int64)  # where match number i - 1 ends and number i starts

    def _learn(self) -> None:
        """Ids of the matches that have a number only."""
        fresh = list(islice(self.number, len(self.ends) - 1, None))
        for at in range(0, len(fresh), 20_000):
            got = [e.ids for e in self.model.encode_batch_fast(fresh[at:at + 20_000], add_special_tokens=False)]
            self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(got), "<u4"))
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum([len(ids) for ids in got]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.number) > MEMORY_ENTRIES:
            self._forget()
        get = self.number.__getitem__
        met = [np.fromiter(map(get, self.find(t)), np.int64) for t in texts]
        self._learn()
        which = np.concatenate(met) if met else np.empty(0, np.int64)
        start, size = self.ends[which], self.ends[which + 1] - self.ends[which]
        upto = np.cumsum(size)
        packed = self.ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(start - upto + size, size)].tobytes()
        cuts = (4 * np.append(0, upto)[np.cumsum([0, *map(len, met)])]).tolist()
        return [packed[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


def _encoder(spec: str, pattern: str) -> Encoder:
    key = (hash(spec), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(spec, pattern)
    return _LOADED[key]


def token_lengths(spec: str) -> np.ndarray:
    """Number of bytes of each token id (each character of a token's spelling is one byte)."""
    vocab = json.loads(spec)["model"]["vocab"]
    out = np.zeros(max(vocab.values(), default=-1) + 1, dtype=np.int64)
    for token, i in vocab.items():
        out[i] = len(token)
    return out


def char_offsets(text: bytes, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last that each token touches."""
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    lead = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
    char = np.cumsum(lead) - 1  # the character each byte belongs to
    return char[starts].astype("<i4"), (char[ends - 1] + 1).astype("<i4")


def _schema(df: DataFrame, added: str) -> str:
    have = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"{have}, {added}" if have else added


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch, each of about ``SLICE_CHARS`` in size."""
    number = np.cumsum(sizes) // SLICE_CHARS
    ends = np.flatnonzero(np.diff(number)) + 1
    yield from zip([0, *ends.tolist()], [*ends.tolist(), len(sizes)], strict=True)


def _sizes(lengths: pa.Array) -> np.ndarray:
    return lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def encode(df: DataFrame, spec: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """``df`` with columns ids (binary: ids as little-endian unsigned 32-bit integers) and n_tokens (long).

    With ``offsets`` also starts and ends (array<int>): for each token the first character it touches
    and the one after the last; tokens that share a split character overlap there.  Columns of these
    names are replaced.  Null and empty texts have no ids.  Every row stays, repeated ones too; an
    empty table gives an empty table.  No special tokens: their strings are ordinary text.
    """
    names = ["ids", "n_tokens"] + ["starts", "ends"] * offsets
    df = df.drop(*names).withColumn(text, F.col(text).cast("string"))
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(spec)  # the vocabulary: its size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(shared.value, pattern)
        lengths = token_lengths(shared.value) if offsets else None
        for batch in batches:
            for lo, hi in _slices(_sizes(pc.utf8_length(batch.column(at)))):
                part = batch.slice(lo, hi - lo)
                texts = [t or "" for t in part.column(at).to_pylist()]
                packed = model.encode(texts)
                more = [pa.array(packed, pa.binary()), pa.array([len(x) // 4 for x in packed], pa.int64())]
                if offsets:
                    places = [char_offsets(t.encode(), np.frombuffer(x, "<u4"), lengths) if x else ((), ())
                              for t, x in zip(texts, packed, strict=True)]
                    more += [pa.array([p[k] for p in places], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *names])

    added = "ids binary, n_tokens bigint" + ", starts array<int>, ends array<int>" * offsets
    return df.mapInArrow(run, _schema(df, added))


def decode(df: DataFrame, spec: str, ids: str = "ids") -> DataFrame:
    """``df`` with columns decoded (binary) and decoded_text (string) from packed ids.

    decoded joins the bytes of the tokens; decoded_text reads them as UTF-8, with U+FFFD for bytes
    that are no character (a character whose bytes lie in several tokens is whole again).  Null ids
    decode to nothing; an id outside the vocabulary raises an error.  Columns of these names are replaced.
    """
    df = df.drop("decoded", "decoded_text")
    at = df.columns.index(ids)
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = {c: b for b, c in enumerate(byte_table())}
        vocab = json.loads(shared.value)["model"]["vocab"]
        token = [b""] * (max(vocab.values(), default=-1) + 1)
        for spelled, i in vocab.items():
            token[i] = bytes(back[c] for c in spelled)
        flat = np.frombuffer(b"".join(token), np.uint8)
        ends = np.append(0, np.cumsum([len(t) for t in token]))
        for batch in batches:
            for lo, hi in _slices(_sizes(pc.binary_length(batch.column(at))) // 4):
                part = batch.slice(lo, hi - lo)
                packed = [x or b"" for x in part.column(at).to_pylist()]
                which = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
                size = ends[which + 1] - ends[which]
                upto = np.cumsum(size)
                text = flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(ends[which] - upto + size, size)].tobytes()
                cuts = np.append(0, upto)[np.cumsum([0, *(len(x) // 4 for x in packed)])].tolist()
                raw = [text[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
                more = [pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more],
                                                 names=[*part.schema.names, "decoded", "decoded_text"])

    return df.mapInArrow(run, _schema(df, "decoded binary, decoded_text string"))


def default_spec(path: str | None = None) -> tuple[str, str]:
    """(tokenizer, pattern) of a rank file; read on the driver, sent to the tasks."""
    import public_tokenizers

    return tokenizer_json(read_ranks(path or public_tokenizers.path(RANKS_NAME))), public_tokenizers.PATTERN


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and whether the text came back."""
    spec, pattern = default_spec(path)
    both = decode(encode(docs.select("doc_id", "text"), spec, pattern), spec)
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded_text") == F.coalesce("text", F.lit(""))).alias("same_text"))


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of the ids and of the decoded bytes."""
    return round_trip(documents(spark, sf_dir))
