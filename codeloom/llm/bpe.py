"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The model is serialised here, straight from the vocabulary: every token's bytes become letters
(printable ASCII stays, any other byte b is the code point 256 + b), a piece's score is its negative rank, normalisation is the
identity. Merging the best-scored pair first is then the rank order of byte-level BPE. Texts are
first cut at white space, each distinct cut is split by the pre-token pattern and encoded once per
worker while it stays in a bounded cache; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import map_arrow, replace_columns, table

#: A space with white space on both sides, or before it at the end: pre-tokens may span it.
_SPANNED = re.compile(r"\s \s|\s \Z")
#: Characters that ``re`` takes for white space and Unicode, as the pre-token pattern, does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No match of the pre-token pattern crosses the border of such a cut.
_CUT = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Punctuation that ends many words; with a word of letters before it, it is one pre-token.
_TAIL = ".,;:!?"

#: Distinct cuts kept by a worker (about 100 MB); the cache starts anew when full.
CACHE_CUTS = 250_000
#: Characters of text that are cut up at once.
SLICE_CHARS = 1_000_000

OUTPUTS = ["n_tokens", "ids_sha256", "decoded_sha256"]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


_TO_LETTERS = {b: b if 32 <= b < 127 else 256 + b for b in range(256)}


def letters(token: bytes) -> str:
    """Bytes as letters, one each: printable ASCII stays, byte b else is the code point 256 + b."""
    return token.decode("latin-1").translate(_TO_LETTERS)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last.

    Ranks must be 0 to n - 1. Field numbers are those of the public sentencepiece_model.proto.
    """
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be consecutive from 0")
    normal, unknown = 1, 2
    out = bytearray()
    for rank, token in enumerate(ordered):
        piece = _field(1, letters(token).encode()) + _field(2, -float(rank)) + _field(3, normal)
        out += _field(1, piece)
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    n = len(ordered)
    no_id = (1 << 64) - 1  # -1: the model has no such piece
    trainer = b"".join(_field(*x) for x in ((3, 2), (4, n + 1), (40, n), (41, no_id), (42, no_id), (43, no_id)))
    normalizer = b"".join(_field(*x) for x in ((1, b"identity"), (3, 0), (4, 0), (5, 0)))
    return bytes(out) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one vocabulary, with its cache."""

    def __init__(self, ranks: dict[bytes, int], model: bytes, pattern: str, cache_cuts: int = CACHE_CUTS) -> None:
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.names = [str(i) for i in range(len(self.tokens))]
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.cache_cuts = cache_cuts
        #: key of a cut -> number of ids, decimal ids joined by spaces, bytes decoded from the ids
        self.cache: dict[str | tuple[str], tuple[int, str, bytes]] = {}

    def _pre_tokens(self, cut: str) -> list[str]:
        """The matches of the pattern in a cut; plain words need no regular expression."""
        body = cut.rstrip(_TAIL)
        if (body[1:] if body[:1] == " " else body).isalpha():
            return [body, cut[len(body) :]] if len(body) < len(cut) else [body]
        return self.split(cut)

    def _learn(self, keys: set[str | tuple[str]]) -> None:
        pre = [self._pre_tokens(" " + k if isinstance(k, str) else k[0]) for k in keys]
        flat = [p if p.isascii() and p.isprintable() else letters(p.encode()) for own in pre for p in own]
        ids = iter(self.processor.encode(flat, num_threads=1) if flat else [])
        names, tokens = self.names, self.tokens
        for key, parts in zip(keys, pre, strict=True):
            own = [i for _ in parts for i in next(ids)]
            self.cache[key] = len(own), " ".join([names[i] for i in own]), b"".join([tokens[i] for i in own])

    @staticmethod
    def keys(text: str) -> list[str | tuple[str]]:
        """The cuts of a text: a string stands for a space and itself, a tuple for its one member.

        Pre-tokens start at a space before a non-space, so such a text is cut at every space
        unless white space adjoins one on both sides.
        """
        if _SPANNED.search(text) or _SEPARATORS.search(text):
            return [c[1:] if c[0] == " " and len(c) > 1 and not c[1].isspace() else (c,) for c in _CUT.findall(text)]
        first, *rest = text.split(" ")
        return [(first,), *rest] if first else rest

    def encode_all(self, texts: list[str]) -> Iterator[list[tuple[int, str, bytes]]]:
        """For each text, what is known of its cuts, in order."""
        cuts = [self.keys(t) for t in texts]
        known = self.cache
        missing = {c for own in cuts for c in own if c not in known}
        if len(known) + len(missing) > self.cache_cuts:
            known.clear()
            missing = {c for own in cuts for c in own}
        self._learn(missing)
        for own in cuts:
            yield [known[c] for c in own]

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        (cuts,) = self.encode_all([text])
        return [int(i) for _, ids, _ in cuts for i in ids.split()]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def _slices(texts: list[str], limit: int) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters; a longer text is a run of its own."""
    part: list[str] = []
    size = 0
    for t in texts:
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _digest(codec: Codec, texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
    counts, ids, decoded = [], [], []
    for part in _slices([t or "" for t in texts], SLICE_CHARS):
        for cuts in codec.encode_all(part):
            counts.append(sum([c[0] for c in cuts]))
            ids.append(hashlib.sha256(" ".join([c[1] for c in cuts]).encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join([c[2] for c in cuts])).hexdigest())
    return counts, ids, decoded


def default_vocabulary() -> tuple[str, str]:
    """Rank file and pre-token pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _codec_on_worker(spark: SparkSession, ranks_path: str | None, pattern: str | None) -> Callable[[], Codec]:
    """The vocabulary travels as a broadcast of some 2 MB, so workers need no file."""
    default_path, default_pattern = default_vocabulary() if ranks_path is None or pattern is None else ("", "")
    ranks = read_ranks(ranks_path or default_path)
    shipped = spark.sparkContext.broadcast((ranks, serialise_model(ranks)))
    rule = pattern or default_pattern

    def make() -> Codec:
        own, model = shipped.value
        return Codec(own, model, rule)

    return make


def bpe_digest(
    docs: DataFrame, text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """All rows and columns of ``docs`` but the text, with n_tokens, ids_sha256 and decoded_sha256.

    A null text counts as empty: no ids, the digests of empty strings. Rows are independent, so
    ties and repeated rows need no rule. Input columns named like an output are replaced.
    """
    docs = replace_columns(docs, OUTPUTS)
    make = _codec_on_worker(docs.sparkSession, ranks_path, pattern)
    others = [c for c in docs.columns if c != text_col]
    schema = docs.select(*others).schema
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for batch in batches:
            n, ids, decoded = _digest(codec, batch.column(batch.num_columns - 1).to_pylist())
            columns = [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, *OUTPUTS])

    return map_arrow(docs.select(*others, F.col(text_col).cast("string")), run, out)


def bpe_encode(
    docs: DataFrame, text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """All rows and columns of ``docs`` with token_ids, an array of int."""
    docs = replace_columns(docs, ["token_ids"])
    make = _codec_on_worker(docs.sparkSession, ranks_path, pattern)

    names = docs.columns
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        at = names.index(text_col)
        for batch in batches:
            ids = pa.array([codec.encode(t or "") for t in batch.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*names, "token_ids"])

    return map_arrow(docs, run, f"{kept}, token_ids array<int>")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of every document."""
    return bpe_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_bpe": op7_bpe}
ORACLES: dict[str, str] = {}
