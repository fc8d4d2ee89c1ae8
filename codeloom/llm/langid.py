"""Language identification by string kernels.

The kernel of two texts is the blended n-gram spectrum by presence: the weighted share of n-grams
(n = 1 to 3, hashed into fixed tables) that both hold. A bounded, documented sample of labelled
texts gives Nystrom landmarks and the rows of a one-versus-rest kernel ridge regression; texts are
then scored in batches by two matrix products.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import map_arrow, replace_columns, table

#: Buckets and weight of each n-gram length.
SPECTRUM = {1: (256, 1.0), 2: (8192, 1.0), 3: (16384, 1.0)}
#: Labelled texts that the model is fitted on, at most, and landmarks among them.
SAMPLE_ROWS = 1500
LANDMARKS = 96
RIDGE = 1e-3
#: Texts scored by one matrix product.
BLOCK_ROWS = 256
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter; the pattern alone takes numbers such as one half for letters."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


#: ASCII that is no letter counts as a space.
_SPACES = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_WIDTH = sum(n for n, _ in SPECTRUM.values())


def presence(text: str, out: np.ndarray) -> None:
    """Mark the n-gram buckets of a whole text in ``out``, a row of ``_WIDTH`` zeros."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_SPACES), np.uint8)
    out[b] = 1
    wide = b.astype(np.uint32)
    pairs = wide[:-1] << 8 | wide[1:]
    out[256 + ((pairs * np.uint32(0x9E3779B1)) >> np.uint32(19))] = 1
    if len(wide) > 2:
        triples = pairs[:-1] << 8 | wide[2:]
        out[256 + 8192 + ((triples * np.uint32(0x9E3779B1)) >> np.uint32(18))] = 1


def _weights() -> np.ndarray:
    return np.concatenate([np.full(n, w, np.float32) for n, w in SPECTRUM.values()])


@dataclass
class Model:
    """Landmarks and the weights of each language."""

    languages: list[str]
    landmarks: np.ndarray  # presence, (landmarks, _WIDTH) bool
    norms: np.ndarray
    beta: np.ndarray  # (landmarks, languages)
    scale: float

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        """The normalised kernel of presence rows with the landmarks."""
        weighted = rows * _weights()
        own = np.sqrt(np.maximum((weighted * rows).sum(1), 1e-9))
        return (weighted @ self.landmarks.T.astype(np.float32)) / own[:, None] / self.norms

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and the probability of each text; ``und`` without letters."""
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        for at in range(0, len(known), BLOCK_ROWS):
            block = known[at : at + BLOCK_ROWS]
            rows = np.zeros((len(block), _WIDTH), np.float32)
            for row, i in zip(rows, block, strict=True):
                presence(texts[i], row)
            decision = self.scale * (self.kernel(rows) @ self.beta)
            odds = np.exp(decision - decision.max(1, keepdims=True))
            odds /= odds.sum(1, keepdims=True)
            best = odds.argmax(1)
            for row, i in enumerate(block):
                languages[i], scores[i] = self.languages[best[row]], float(odds[row, best[row]])
        return languages, scores


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model of texts on the driver."""
    rows = np.zeros((len(texts), _WIDTH), bool)
    for row, text in zip(rows, texts, strict=True):
        presence(text, row)
    return fit_rows(rows, labels, landmarks, ridge)


def fit_rows(rows: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nystrom features of balanced landmarks, then kernel ridge regression against each rest."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((0, _WIDTH), bool), np.zeros(0, np.float32), np.zeros((0, 0), np.float32), 1.0)
    each = max(1, landmarks // len(languages))
    chosen = np.concatenate([np.flatnonzero(np.array(labels) == x)[:each] for x in languages])
    marks = rows[chosen]
    weights = _weights()
    norms = np.sqrt(np.maximum(marks @ weights, 1e-9)).astype(np.float32)
    model = Model(languages, marks, norms, np.zeros((len(chosen), len(languages)), np.float32), 8.0)
    among = model.kernel(marks.astype(np.float32)).astype(np.float64)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    features = np.concatenate([model.kernel(rows[i : i + BLOCK_ROWS].astype(np.float32)) for i in range(0, len(rows), BLOCK_ROWS)]) @ whiten
    # Each language weighs the same, however many rows it has in the sample.
    counts = np.array([labels.count(x) for x in languages], float)
    per_row = np.array([1 / counts[languages.index(x)] for x in labels])
    targets = np.array([[1.0 if x == y else -1.0 for y in languages] for x in labels])
    gram = features.T @ (features * per_row[:, None]) + ridge * np.eye(features.shape[1])
    model.beta = (whiten @ np.linalg.solve(gram, features.T @ (targets * per_row[:, None]))).astype(np.float32)
    return model


def labelled_sample(docs: DataFrame, text_col: str, label_col: str, id_col: str, rows: int) -> tuple[np.ndarray, list[str]]:
    """Presence rows and labels of up to ``rows`` labelled texts, as many of each label, picked by a hash of the id.

    Executors mark the n-grams, so the driver gets some three kilobytes a text, however long it is.
    Rows without a text, a label or an id teach nothing.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for text in batch.column(2).to_pylist():
                row = np.zeros(_WIDTH, bool)
                presence(text, row)
                packed.append(np.packbits(row).tobytes() if has_letter(text) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "label", "marks"])

    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    labels = labelled.select(label_col).distinct().count()
    if not labels:
        return np.zeros((0, _WIDTH), bool), []
    each = max(1, rows // labels)
    # Spark keeps the first rows of each label already on the map side, so a hot label is no matter.
    order = Window.partitionBy("__label").orderBy(F.xxhash64(F.col("__id").cast("string")), F.col("__id"))
    picked = (
        labelled.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"))
        .withColumn("__n", F.row_number().over(order))
        .where(F.col("__n") <= each)
        .orderBy("__n", F.xxhash64(F.col("__id").cast("string"), "__label"), "__id", "__label")
        .limit(rows)
    )
    ids = sorted({r["__id"] for r in picked.select("__id").collect()})
    wanted = labelled.where(F.col(id_col).isin(ids)).select(F.col(id_col).cast("string"), F.col(label_col).cast("string"), F.col(text_col).cast("string"))
    # of rows that share id and label the one of least marks counts, so the sample is the same in any order
    marked = map_arrow(wanted, mark, "id string, label string, marks binary").where("marks is not null")
    found = marked.groupBy("id", "label").agg(F.min("marks").alias("marks")).collect()
    found.sort(key=lambda r: (r["id"], r["label"], bytes(r["marks"])))
    marks = [np.unpackbits(np.frombuffer(r["marks"], np.uint8))[:_WIDTH].astype(bool) for r in found]
    return np.array(marks, bool).reshape(-1, _WIDTH), [r["label"] for r in found]


def held_out(id_col: str) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` but the text, with lang_pred and score.

    ``und`` and 0 where the text is null or has no letter. Rows are independent, so ties and
    repeated rows need no rule. Input columns named like an output are replaced.
    """
    docs = replace_columns(docs, ["lang_pred", "score"])
    others = [c for c in docs.columns if c != text_col]
    kept = docs.select(*others).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string, score double"])
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most LANDMARKS x _WIDTH bytes and a bit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            names, scores = own.predict(batch.column(batch.num_columns - 1).to_pylist())
            made = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*others, "lang_pred", "score"])

    return map_arrow(docs.select(*others, F.col(text_col).cast("string")), run, schema)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    marks, labels = labelled_sample(docs.where(~held_out("doc_id") & F.col("doc_id").isNotNull()), "text", "lang", "doc_id", SAMPLE_ROWS)
    return identify(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), fit_rows(marks, labels))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_langid": op3_langid}
ORACLES: dict[str, str] = {}
