"""Exact and near dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from codeloom.llm import exact_dedup, near_dedup, sketch

SCHEMA = "doc_id bigint, text string"


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


ROWS = [(1, "Foo"), (2, "foo"), (3, "FÉ"), (4, "fÉ"), (5, "fé"), (6, None), (7, ""), (None, "foo"), (None, "solo"), (8, "x" * 50_000), (9, "X" * 50_000), (2, "foo"), (10, "bar")]


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"slots_per_row": 0.1},  # two slots: every row is suspected
        {"max_filter_blocks": 1, "slots_per_row": 2},
        {"hot_least": 2},  # every group of copies is dealt to several partitions
    ],
)
def test_exact_matches_brute_force(spark, options):
    df = spark.createDataFrame([(*r, "k", 1) for r in ROWS], SCHEMA + ", kept string, extra int")
    out = exact_dedup.annotate(df, **options).collect()
    assert len(out) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(ascii_lower(t), []).append(i)
    kept = {}
    for r in out:
        own = groups[ascii_lower(r.text)]
        ids = [i for i in own if i is not None]
        assert r.group_size == len(own)
        assert r.keep_id == (max(ids) if ids else None)
        assert r.text_sha256 == hashlib.sha256(ascii_lower(r.text).encode()).hexdigest()
        kept[ascii_lower(r.text)] = kept.get(ascii_lower(r.text), 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_of_an_empty_table(spark):
    assert exact_dedup.annotate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_exact_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "A", 6)], SCHEMA + ", group_size int")
    assert [r.asDict() for r in exact_dedup.exact_dedup(df).collect()] == [{"doc_id": 2, "text": "A", "group_size": 6}]


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", ascii_lower(t)) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(seed, members, words, edits):
    random.seed(seed)
    base = [f"w{random.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(members):
        own = list(base)
        for _ in range(random.randrange(edits + 1)):
            own[random.randrange(words)] = f"e{random.randrange(10_000)}"
        out.append(" ".join(own))
    return out


def test_near_matches_brute_force(spark):
    texts = family(1, 60, 120, 6) + family(2, 30, 300, 20) + family(3, 15, 12, 1) + ["", None, " \n ", "one", "ONE", "two words", "a b c d", "A  b\tc d", "a b c d e", "a\xa0b c d e f"]
    rows = list(enumerate(texts, 1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.annotate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_components(rows)


def test_near_links_edited_copies_only_by_their_original(spark):
    random.seed(5)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(1000):
        own = list(base)
        for place in random.sample(range(200), 1 + i % 3):
            own[place] = f"e{random.randrange(10**9)}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts, 1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.annotate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_components(rows)
    assert {c for _, c in got.values()} == {1}


def test_near_keeps_one_of_each_component(spark):
    rows = [(i, t, "c") for i, t in enumerate(family(4, 20, 100, 1), 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", kept string")
    kept = near_dedup.near_dedup(df).collect()
    assert {r.doc_id for r in kept} == {c for _, c in brute_components([r[:2] for r in rows]).values()}
    assert kept[0].kept == "c"


def test_near_with_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (None, "z"), (4, "q r s"), (4, "other text here"), (5, "Q r s")], SCHEMA)
    out = sorted(((r.doc_id or 0, r.text, r.component_id, r.kept) for r in near_dedup.annotate(df).collect()), key=str)
    assert out == sorted([(0, "a b c d e", 3, False), (3, "a b c d e", 3, True), (0, "z", None, True), (4, "q r s", 4, True), (4, "other text here", 4, True), (5, "Q r s", 4, False)], key=str)


def test_near_copies_without_ids_are_linked(spark):
    texts = family(6, 4, 200, 1)
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (None, "alone " * 3), (None, "alone alone alone"), (8, "x" * 300_000)]
    out = near_dedup.annotate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [(0, 0, False), (0, 0, True), (0, 7, False), (0, 7, False), (7, 7, True), (8, 8, True)]


def test_near_tests_members_beyond_the_star(spark):
    """A chain of edits in one bucket: each text links to its neighbours only."""
    random.seed(9)
    own = [f"w{i}" for i in range(200)]
    texts = [" ".join(own)]
    for i in range(40):
        own[(i * 7) % 200] = f"e{i}"
        own[(i * 7 + 90) % 200] = f"f{i}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts, 1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.annotate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_components(rows) and {c for _, c in got.values()} == {1}


def test_near_work_on_one_group_grows_with_its_members(spark, monkeypatch):
    """Copies with up to ten edits, many of which link with nothing: few differences each, few pairs to confirm."""
    random.seed(11)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i in range(500):
        own = list(base)
        for place in random.sample(range(120), 1 + i % 10):
            own[place] = f"e{random.randrange(10**9)}"
        texts.append(" ".join(own))
    made, put = {}, near_dedup.Scratch.put

    def counted(self, name, df):
        out = put(self, name, df)
        if name == "deltas":
            made[name] = out.select("other", "node").distinct().count()
        elif name in ("ranked", "open-pairs"):
            made[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup.Scratch, "put", counted)
    rows = list(enumerate(texts, 1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.annotate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_components(rows) and len({c for _, c in got.values()}) > 100
    assert made["deltas"] <= 2 * len(rows) and made["open-pairs"] <= len(rows), made


def test_near_of_an_empty_table(spark):
    assert near_dedup.annotate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sparse_sketches_use_all_their_values():
    """Each empty bin of a set of two shingles takes either one alike, so a band of four has only the first in 1 of 16."""
    import numpy as np

    rng = np.random.default_rng(1)
    shares = []
    for _ in range(300):
        two = np.sort(sketch.mix(rng.integers(0, 2**63, 2, dtype=np.uint64)))
        shares.append((sketch.sketch(two) == sketch.sketch(two[:1])).mean())
    assert 0.03 < np.mean(shares) < 0.12


def test_band_collisions_follow_similarity():
    """Sets of Jaccard similarity 0.85 share a band nearly always, unrelated sets never."""
    import numpy as np

    rng = np.random.default_rng(0)
    hits = 0
    for _ in range(200):
        common = rng.integers(0, 2**63, 170, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, 15, dtype=np.uint64)])) for _ in range(2))
        hits += bool((sketch.sketch(np.sort(sketch.mix(a))) == sketch.sketch(np.sort(sketch.mix(b)))).any())
        assert not (sketch.fine_sketch(a) == sketch.fine_sketch(rng.integers(0, 2**63, 185, dtype=np.uint64))).any()
    assert hits == 200
