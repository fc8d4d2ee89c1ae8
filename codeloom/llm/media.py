"""Media columns: texts stored as lossless WebP images, read back and described."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import webp
from codeloom.llm.common import map_arrow, replace_columns, table

DIGESTS = {
    "n_bytes": "bigint",
    "payload_bytes": "bigint",
    "payload_sha256": "string",
    "tail_crc32": "bigint",
    "media_bytes": "bigint",
    "media_sha256": "string",
    "feature": "string",
}


def describe(images: list[np.ndarray]) -> str:
    """Number of images, width, rows, and the sums of red, green and blue samples."""
    # by column first, as numpy adds long rows faster than many short ones
    columns = [i.reshape(len(i), -1).sum(axis=0, dtype=np.int64).reshape(-1, 4) for i in images]
    sums = np.concatenate(columns).sum(axis=0)[1:]
    return "|".join(map(str, [len(images), images[0].shape[1], sum(len(i) for i in images), *sums.tolist()]))


Digest = tuple[int, int, str, int, int, str, str]
#: Texts that are stored before the first of them is read back: a processor repeats one kind of work faster.
_AT_ONCE = 64


def digests(raws: list[bytes]) -> list[Digest]:
    """Store the bytes of texts, read them back and compute the columns of ``DIGESTS``."""
    out: list[Digest] = []
    for first in range(0, len(raws), _AT_ONCE):
        some = raws[first : first + _AT_ONCE]
        stored = [webp.encode_payload(webp.pad_payload(raw)) for raw in some]
        out += [_read_back(len(raw), media) for raw, media in zip(some, stored, strict=True)]
    return out


def digest(raw: bytes) -> Digest:
    """The columns of ``DIGESTS`` of one text."""
    return digests([raw])[0]


def _read_back(n_bytes: int, media: bytes) -> Digest:
    images = webp.decode_files(media)
    back = b"".join([i[:, :, 1:].tobytes() for i in images])
    return (
        n_bytes,
        len(back),
        hashlib.sha256(back).hexdigest(),
        zlib.crc32(back[-32:]),
        len(media),
        hashlib.sha256(media).hexdigest(),
        describe(images),
    )


def to_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``media``: the UTF-8 text as lossless WebP.

    A null text counts as empty and is one row of white pixels. Equal texts give equal bytes.
    """
    docs = replace_columns(docs, ["media"])

    @F.pandas_udf("binary")
    def encode(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: webp.encode_payload(webp.pad_payload((t or "").encode())))

    return docs.withColumn("media", encode(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def from_media(frames: DataFrame, media_col: str = "media") -> DataFrame:
    """All rows and columns with ``width``, ``rows`` and ``pixels`` (RGB samples); null stays null."""
    frames = replace_columns(frames, ["width", "rows", "pixels"])

    @F.pandas_udf("width int, rows int, pixels binary")
    def decode(media):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for m in media:
            images = webp.decode_files(bytes(m)) if m else []
            ok = bool(images)
            out.append((images[0].shape[1] if ok else None, sum(map(len, images)) if ok else None, b"".join([i[:, :, 1:].tobytes() for i in images]) if ok else None))
        return pd.DataFrame(out, columns=["width", "rows", "pixels"])

    return frames.withColumn("__image", decode(F.col(media_col))).select(*frames.columns, "__image.*")


def media_digest(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` but the text, with the columns of ``DIGESTS``.

    A null text counts as empty. Rows are independent, so ties and repeated rows need no rule.
    Input columns named like an output are replaced.
    """
    docs = replace_columns(docs, list(DIGESTS))
    others = [c for c in docs.columns if c != text_col]
    kept = docs.select(*others).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} {t}" for n, t in DIGESTS.items())])
    arrow = [pa.int64() if t == "bigint" else pa.string() for t in DIGESTS.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = digests([b"" if raw is None else raw for raw in batch.column(batch.num_columns - 1).to_pylist()])
            columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
            made = [pa.array(list(c), t) for c, t in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*others, *DIGESTS])

    return map_arrow(docs.select(*others, F.col(text_col).cast("string").cast("binary")), run, schema)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as WebP and read back."""
    return media_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_media": op10_media}
ORACLES: dict[str, str] = {}
