"""License scans: ordered signature rules over texts with A-Z lower-cased.

A rule is a regular expression with a label, a priority and keywords: single words, one of which is
in each of its matches however the words are parted. A text is searched only with the rules of which
it holds a keyword. Detections are taken by falling priority, then length, then place, then label;
whatever lies inside a detection that was taken is suppressed, and so is an equal span of the same or
a lower rank. Detections that overlap only in part all stay, whatever their ranks, because each covers
text that the other doesn't. The rules in ``license_rules`` are written by hand; identifiers in SPDX
tags and the terms and versions of Creative Commons, which follow a scheme, are made from it. Four
base phrases are counted word by word beside them and their labels always stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import map_arrow, replace_columns, table
from codeloom.llm.license_rules import SIGNATURES

_WORD = rb"[0-9a-z\x80-\xff]"
_GAP = rb"[^0-9a-z\x80-\xff]+"
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True

#: Fixed values of the query contract: phrase and label.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

OUTPUTS = {
    "n_words": "bigint",
    "n_base": "bigint",
    "first_word": "bigint",
    "last_word": "bigint",
    "base_labels": "string",
    "labels": "string",
    "score": "double",
}


@dataclass(frozen=True)
class Rule:
    """One signature."""

    label: str
    pattern: re.Pattern[bytes]
    priority: int
    keywords: tuple[bytes, ...]


#: Creative Commons: terms in the order of a label, and their names in full.
_CC_TERMS = {
    "by": "attribution",
    "by-nc": "attribution non commercial",
    "by-nc-nd": "attribution non commercial no derivatives",
    "by-nc-sa": "attribution non commercial share alike",
    "by-nd": "attribution no derivatives",
    "by-sa": "attribution share alike",
}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0", "")

def _phrase(words: str) -> bytes:
    """The words in a row, with anything but words between them."""
    return _GAP.join(re.escape(w.encode()) for w in re.findall(r"[0-9a-z]+", words))


def _bounded(pattern: bytes) -> re.Pattern[bytes]:
    return re.compile(rb"(?<!" + _WORD + rb")(?:" + pattern + rb")(?!" + _WORD + rb")")


#: An optional "version" and what may stand around it.
_VERSION = rb"(?:(?:version|ver|v)[^0-9a-z\x80-\xff]*)?"


def _expression(written: str) -> bytes:
    """The regular expression that a rule's notation stands for."""
    return written.encode("latin-1").replace(b" ", _GAP).replace(b"#", _VERSION)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All signatures, by falling priority."""
    out: list[Rule] = []

    def add(label: str, pattern: bytes, priority: int, keywords: list[str]) -> None:
        out.append(Rule(label, _bounded(pattern), priority, tuple(k.encode() for k in keywords)))

    for line in SIGNATURES.strip().splitlines():
        label, priority, keywords, written = line.split(" :: ")
        add(label, _expression(written), int(priority), keywords.split())
    for terms, name in _CC_TERMS.items():
        loose = name.replace("non commercial", "noncommercial").replace("share alike", "sharealike").replace("no derivatives", "noderivatives")
        for version in _CC_VERSIONS:
            label = f"cc-{terms}-{version}" if version else f"cc-{terms}"
            tail = _expression(f" #{re.escape(version)}") if version else b""
            rank = 60 + 4 * terms.count("-") + (8 if version else 0)
            add(label, _phrase(f"cc {terms}") + tail, rank, ["cc"])
            for full in dict.fromkeys((name, loose)):
                add(label, _phrase(f"creative commons {full}") + tail, rank, ["creative"])
            add(label, rb"creativecommons\.org/licenses/" + re.escape(terms.encode()) + (rb"/" + re.escape(version.encode()) if version else b""), rank + 10, ["creativecommons"])
    for label in sorted({r.label for r in out}):
        add(label, rb"spdx-license-identifier:\s*" + re.escape(label.encode()), 90, ["spdx"])
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def _by_keyword() -> dict[bytes, list[int]]:
    out: dict[bytes, list[int]] = {}
    for i, rule in enumerate(rules()):
        for k in rule.keywords:
            out.setdefault(k, []).append(i)
    return out


_BASE = [(label, _bounded(_phrase(phrase))) for phrase, label in BASE_PHRASES.items()]


def detect(low: bytes) -> list[tuple[int, int, str, int]]:
    """Detections in lower-cased text that survive suppression: start, end, label, priority."""
    wanted = sorted({i for k, own in _by_keyword().items() if k in low for i in own})
    found = [(m.start(), m.end(), r.label, r.priority) for r in (rules()[i] for i in wanted) for m in r.pattern.finditer(low)]
    found.sort(key=lambda d: (-d[3], d[0] - d[1], d[0], d[2]))
    # Largest end of the kept detections by rank of start, as a Fenwick tree of prefix maxima.
    rank = {start: i for i, start in enumerate(sorted({d[0] for d in found}), 1)}
    furthest = [0] * (len(rank) + 1)
    kept: list[tuple[int, int, str, int]] = []
    for d in found:
        i, reach = rank[d[0]], 0
        while i:
            reach = max(reach, furthest[i])
            i &= i - 1
        if reach >= d[1]:
            continue
        kept.append(d)
        i = rank[d[0]]
        while i < len(furthest):
            furthest[i] = max(furthest[i], d[1])
            i += i & -i
    return sorted(kept)


def scan(raw: bytes | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """The columns of ``OUTPUTS`` for the UTF-8 bytes of a text; null counts as empty."""
    if not raw:
        return 0, 0, None, None, "", "", 0.0
    low = raw.lower()
    word = _IS_WORD[np.frombuffer(low, np.uint8)]
    n_words = int(np.count_nonzero(word[1:] > word[:-1])) + int(word[0])
    places = [(m.start(), label) for label, pattern in _BASE for m in pattern.finditer(low)]
    found = detect(low)
    base = {label for _, label in places}
    first = last = None
    if places:
        starts = np.flatnonzero(np.concatenate((word[:1], word[1:] > word[:-1])))
        at = np.searchsorted(starts, [p for p, _ in places])
        first, last = int(at.min()), int(at.max())
    labels = base | {d[2] for d in found}
    score = max([0.5 if base else 0.0, *(min(1.0, d[3] / 100) for d in found)])
    return n_words, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def license_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` but the text, with the columns of ``OUTPUTS``.

    A null text counts as empty. Rows are independent, so ties and repeated rows need no rule.
    Input columns named like an output are replaced.
    """
    docs = replace_columns(docs, list(OUTPUTS))
    others = [c for c in docs.columns if c != text_col]
    kept = docs.select(*others).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} {t}" for n, t in OUTPUTS.items())])
    arrow = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(raw) for raw in batch.column(batch.num_columns - 1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in OUTPUTS]
            made = [pa.array(list(c), arrow[t]) for c, t in zip(columns, OUTPUTS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*others, *OUTPUTS])

    return map_arrow(docs.select(*others, F.col(text_col).cast("string").cast("binary")), run, schema)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License mentions of every document."""
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_licenses": op4_licenses}
ORACLES: dict[str, str] = {}
