"""Quality classification by co-training two views of a document.

The text-content view reads the words: repetition, capitals, symbols. The metadata view reads the
columns beside the text and never the text: source, language and recorded length. Both are logistic
regressions, at first of a bounded sample of the labelled documents. Then, in rounds, each view learns
from all documents outside that sample of whose label the other view is sure. Their features lie in a
table; each Newton step of both views is one pass over it that adds up gradients and curvatures on the
executors, so what reaches the driver doesn't depend on the number of documents. Confident documents
of a class weigh together as much as its labelled ones. Held-out labelled documents calibrate both
views and weigh their log-odds; the combined model scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, map_arrow, replace_columns, table

#: Labelled documents that the model is fitted on, at most; every fifth of them calibrates.
LABELLED_ROWS = 3000
#: Rounds of exchanged labels, and Newton steps of both views in each.
ROUNDS, STEPS = 3, 3
#: Least curvature of a document in these steps: rows that contradict a view can't throw it far off.
FLOOR = 0.1
#: A view's label counts if its probability lies this close to 0 or 1.
CONFIDENCE = 0.05
#: Documents are kept from this probability of good quality on.
THRESHOLD = 0.5

_SOURCES, _LANGS = 32, 8
CONTENT_FEATURES = 13
META_FEATURES = 2 + _SOURCES + _LANGS
#: Numbers at the start of each view's features that also count squared; the rest are indicators.
_SQUARED = (CONTENT_FEATURES, 2)
OUTPUTS = ["content_score", "meta_score", "quality_score", "keep"]

_UPPER, _LOWER = np.arange(65, 91), np.arange(97, 123)
_DIGITS = np.arange(48, 58)
_SYMBOLS = np.array([b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?"])


def content_features(raw: bytes) -> list[float]:
    """Shares of the words and characters of a whole text."""
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * (CONTENT_FEATURES - 1) + [1.0]
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(seen[_UPPER].sum()), int(seen[_LOWER].sum())
    beyond = int(seen[128:].sum())
    letters = upper + lower + beyond
    symbols = int(seen[_SYMBOLS].sum())
    repeats = sum(map(eq, words, words[1:]))
    distinct = len(set(words))
    return [
        repeats / n,
        distinct / n,
        distinct / n**0.8,
        upper / (letters + 1),
        symbols / size,
        min(1.0, symbols / n),
        int(seen[124]) / n,
        int(seen[33]) / n,
        int(seen[_DIGITS].sum()) / size,
        beyond / size,
        min(40.0, letters / n),
        (int(seen[46]) + int(seen[44])) / n,
        0.0,
    ]


def meta_features(source: str | None, lang: str | None, length: float | None) -> list[float]:
    """Recorded length, whether there is one, and hashed source and language."""
    out = [0.0 if length is None else float(np.log1p(max(0.0, length))), float(length is None)]
    one = [0.0] * (_SOURCES + _LANGS)
    one[zlib.crc32((source or "").encode()) % _SOURCES] = 1.0
    one[_SOURCES + zlib.crc32((lang or "").encode()) % _LANGS] = 1.0
    return out + one


@dataclass
class Logistic:
    """Standardised logistic regression with squares of the first features."""

    mean: np.ndarray
    spread: np.ndarray
    squared: int
    weights: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        first = z[:, : self.squared]
        return np.hstack([np.ones((len(z), 1)), z, first * first / 8])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.expand(x) @ self.weights, -30, 30)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-v))


def _slopes(z: np.ndarray, y: np.ndarray | float, weights: np.ndarray, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss; a row's curvature is at least ``floor``."""
    p = _sigmoid(np.clip(z @ weights, -30, 30))
    return z.T @ (p - y), (z * np.maximum(p * (1 - p), floor)[:, None]).T @ z


def _newton(z: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    w = np.zeros(z.shape[1])
    ridge = penalty * np.eye(z.shape[1])
    for _ in range(25):
        gradient, curvature = _slopes(z, y, w)
        step = np.linalg.solve(curvature + ridge, gradient + ridge @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


PENALTY = 1.0


def fit_logistic(x: np.ndarray, y: np.ndarray, squared: int) -> Logistic:
    model = Logistic(x.mean(0), np.maximum(x.std(0), 1e-3), squared, np.zeros(1 + x.shape[1] + squared))
    model.weights = _newton(model.expand(x), y, PENALTY)
    return model


@dataclass
class Model:
    """Two calibrated views and their combination; a constant where the labels can teach nothing."""

    constant: float | None
    views: tuple[Logistic, Logistic] | None = None
    calibration: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 1.0), (0.0, 1.0))
    combination: tuple[float, float, float] = (0.0, 0.5, 0.5)
    taught: tuple[int, ...] = ()  # documents that the last round learnt from: by view, then bad and good

    def scores(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Probabilities of good quality: content view, metadata view, combined."""
        if self.views is None:
            return np.full((len(content), 3), self.constant)
        odds = [a + b * v.log_odds(x) for v, x, (a, b) in zip(self.views, (content, meta), self.calibration, strict=True)]
        bias, first, second = self.combination
        return _sigmoid(np.clip(np.column_stack([*odds, bias + first * odds[0] + second * odds[1]]), -30, 30))


def _calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: bias and a slope that never turns the order round."""
    a, b = _newton(np.column_stack([np.ones(len(odds)), odds]), y, 0.1)
    return float(a), max(float(b), 0.01)


#: By view and class: documents that the other view is sure of, and the gradient and curvature of their loss.
Slopes = list[list[tuple[float, np.ndarray, np.ndarray]]]


def confident_slopes(rows: tuple[np.ndarray, np.ndarray], tellers: tuple[Logistic, Logistic], views: tuple[Logistic, Logistic]) -> Slopes:
    """What each view learns from ``rows``, of whose label the other teller is sure."""
    sure = [_sigmoid(t.log_odds(x)) for t, x in zip(tellers, rows, strict=True)]
    out: Slopes = []
    for v, view in enumerate(views):
        z, told = view.expand(rows[v]), sure[1 - v]
        out.append([(float(m.sum()), *_slopes(z[m], y, view.weights, FLOOR)) for y, m in ((0.0, told <= CONFIDENCE), (1.0, told >= 1 - CONFIDENCE))])
    return out


def co_train(content: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Callable[[tuple[Logistic, Logistic], tuple[Logistic, Logistic]], Slopes] | None = None) -> Model:
    """Rounds of exchanged labels, then calibration on every fifth labelled row.

    ``pool`` gives the ``confident_slopes`` of all unlabelled documents. With fewer than ten labelled
    rows, or of one class only, nothing can be told apart: the model is the constant 1, which keeps all.
    """
    if len(set(y.tolist())) < 2 or len(y) < 10:
        return Model(1.0)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    x, own = (content[~held], meta[~held]), y[~held]
    views = tuple(fit_logistic(rows, own, squared) for rows, squared in zip(x, _SQUARED, strict=True))
    taught: tuple[int, ...] = ()
    for _ in range(ROUNDS if pool else 0):
        tellers = views
        for _ in range(STEPS):
            slopes = pool(tellers, views)
            taught = tuple(int(n) for told in slopes for n, _, _ in told)
            views = tuple(_step(view, rows, own, told) for view, rows, told in zip(views, x, slopes, strict=True))
    test = held if held.any() else ~held
    raw = [v.log_odds(z[test]) for v, z in zip(views, (content, meta), strict=True)]
    calibration = tuple(_calibrate(r, y[test]) for r in raw)
    odds = [a + b * r for (a, b), r in zip(calibration, raw, strict=True)]
    bias, first, second = _newton(np.column_stack([np.ones(test.sum()), *odds]), y[test], 0.1)
    if first <= 0:
        bias, first, second = 0.0, 1.0, 0.0
    return Model(None, views, calibration, (float(bias), float(first), max(float(second), 0.0)), taught)


def _step(view: Logistic, x: np.ndarray, y: np.ndarray, told: list[tuple[float, np.ndarray, np.ndarray]]) -> Logistic:
    """The view after a Newton step over its labelled rows and, weighing as much, those the other view told it."""
    gradient, curvature = _slopes(view.expand(x), y, view.weights, FLOOR)
    for label, (n, own_gradient, own_curvature) in zip((0.0, 1.0), told, strict=True):
        if n:
            weight = min(1.0, float((y == label).sum()) / n)
            gradient, curvature = gradient + weight * own_gradient, curvature + weight * own_curvature
    ridge = PENALTY * np.eye(len(view.weights))
    step = np.linalg.solve(curvature + ridge, gradient + ridge @ view.weights)
    return Logistic(view.mean, view.spread, view.squared, view.weights - np.clip(step, -5, 5))


def _feature_arrays(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """text, source, language, length -> the features of both views."""
    texts, sources, langs, lengths = (c.to_pylist() for c in columns)
    content = np.array([content_features(t or b"") for t in texts], float).reshape(-1, CONTENT_FEATURES)
    meta = np.array([meta_features(*row) for row in zip(sources, langs, lengths, strict=True)], float)
    return content, meta.reshape(-1, META_FEATURES)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _features(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """id, content, meta of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, meta = _feature_arrays(batch.columns[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(content), _lists(meta)], names=["id", "content", "meta"])

    return map_arrow(docs.select("id", *columns), run, "id bigint, content array<double>, meta array<double>")


def _pool(features: DataFrame, tellers: tuple[Logistic, Logistic], views: tuple[Logistic, Logistic]) -> Slopes:
    """The ``confident_slopes`` of a table of features, summed on the executors."""
    sizes = [len(v.weights) for v in views]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            rows = (_matrix(batch.column(0), CONTENT_FEATURES), _matrix(batch.column(1), META_FEATURES))
            flat = np.concatenate([np.concatenate(([n], g, h.ravel())) for told in confident_slopes(rows, tellers, views) for n, g, h in told])
            total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"])

    sums = map_arrow(features.select("content", "meta"), run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value"))
    flat = np.zeros(sum(2 * (1 + n + n * n) for n in sizes))
    for r in sums.collect():  # one row for each number of both views' sums
        flat[r["at"]] = r["value"]
    out: Slopes = []
    at = 0
    for n in sizes:
        told = []
        for _ in range(2):
            told.append((flat[at], flat[at + 1 : at + 1 + n], flat[at + 1 + n : at + 1 + n + n * n].reshape(n, n)))
            at += 1 + n + n * n
        out.append(told)
    return out


def _prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, size_col: str) -> tuple[DataFrame, list[Column]]:
    """Input columns under fixed names; a missing source, language or length counts as null."""
    null = F.lit(None)
    source, lang, size = (F.col(c) if c in docs.columns else null for c in (source_col, lang_col, size_col))
    columns = [F.col(text_col).cast("string").cast("binary"), source.cast("string"), lang.cast("string"), size.cast("double")]
    return docs.withColumn("id", F.col(id_col).cast("bigint")), [c.alias(f"__in{i}") for i, c in enumerate(columns)]


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    size_col: str = "n_chars", label_col: str = "quality", labelled_rows: int = LABELLED_ROWS,
) -> Model:
    """Co-train on up to ``labelled_rows`` labelled documents and all others.

    The sample comes first by a hash of the id. Labels are 0 and 1; rows with a null label or id teach
    nothing, of several labels of a document the least counts, and of several rows that share an id
    the one of least features.
    """
    scratch = Scratch(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(F.col(label_col).cast("double")).alias("label"))
    prepared, columns = _prepared(docs, id_col, text_col, source_col, lang_col, size_col)
    features = scratch.put("features", _features(prepared, columns))
    sample = known.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(labelled_rows)
    sample = docs.sparkSession.createDataFrame(sample.collect(), "id bigint, label double")  # labelled_rows at most
    rows = features.join(F.broadcast(sample), "id").groupBy("id").agg(F.min(F.struct("content", "meta", "label")).alias("row"))
    found = [r["row"] for r in rows.orderBy(F.xxhash64("id", F.lit("sample")), "id").collect()]
    others = features.join(F.broadcast(sample.select("id")), "id", "left_anti")

    def stack(view: str, width: int) -> np.ndarray:
        return np.array([r[view] for r in found], float).reshape(-1, width)

    y = np.array([float(r["label"] > 0) for r in found])
    model = co_train(stack("content", CONTENT_FEATURES), stack("meta", META_FEATURES), y, lambda tellers, views: _pool(others, tellers, views))
    scratch.drop("features")
    return model


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    size_col: str = "n_chars", carry_text: bool = True,
) -> DataFrame:
    """All rows and columns of ``docs`` with the columns of ``OUTPUTS``; without the text if not carried.

    A null text counts as empty. Rows are independent: equal rows get equal scores, and a score of
    just ``THRESHOLD`` is kept. Input columns named like an output are replaced.
    """
    docs = replace_columns(docs, OUTPUTS)
    others = [c for c in docs.columns if carry_text or c != text_col]
    kept = docs.select(*others).schema
    _, columns = _prepared(docs, id_col, text_col, source_col, lang_col, size_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "content_score double, meta_score double, quality_score double, keep boolean"])
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # some kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, meta = _feature_arrays(batch.columns[len(others) :])
            scores = shipped.value.scores(content, meta)
            made = [pa.array(scores[:, i]) for i in range(3)] + [pa.array(scores[:, 2] >= THRESHOLD)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *made], names=[*others, *OUTPUTS])

    return map_arrow(docs.select(*others, *columns), run, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of both views, the combined score and the decision for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, carry_text=False).select("doc_id", *OUTPUTS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_quality": op8_quality}
ORACLES: dict[str, str] = {}
