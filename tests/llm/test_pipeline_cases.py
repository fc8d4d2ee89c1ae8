"""The corpus pipeline on small tables with nulls, repeats, clashing columns and no rows, against brute force."""

from __future__ import annotations

import hashlib
import random

from test_dedup import ascii_lower, brute_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def written(spark, folder, rows, extra="", labels=()):
    spark.createDataFrame(rows, SCHEMA + extra).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def documents():
    random.seed(11)
    words = {"en": "the of and to in that is was he for".split(), "de": "der die und in den von zu das mit sich".split(), "fr": "le de et la les des en un du une".split(), "es": "que el en y los del se las por un".split()}
    out = []
    for i in range(120):
        lang = random.choice(["en"] * 5 + ["de", "fr", "es"])
        text = " ".join(random.choice(words[lang]) + random.choice("abcdefgh") for _ in range(random.randrange(8, 60)))
        out.append((i, text, lang, f"src{i % 3}", len(text)))
    out += [(200 + i, out[i][1].upper(), out[i][2], "copy", out[i][4]) for i in range(20)]  # equal but for case
    out += [(300 + i, out[40 + i][1] + " " + out[40 + i][1] + " tail", "en", None, None) for i in range(3)]
    long = " ".join(f"w{i}" for i in range(20_000))
    return [*out, (400, long, "en", "src0", None), (401, long + " more", "en", "src0", None), (500, None, None, None, None), (501, "", "en", "src1", 0), (502, " \n", "en", "src1", 2)]


def survivors(rows):
    """Ids that exact and near dedup keep, for rows with ids."""
    best = {}
    for i, text, *_ in rows:
        key = ascii_lower(text)
        best[key] = max(best.get(key, -1), i)
    left = [(i, t) for i, t, *_ in rows if best[ascii_lower(t)] == i]
    parts = brute_components(left)
    return {i for i, _ in left if parts[i][1] == i}, dict(left)


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as pipeline

    rows = documents()
    clash = [(*r, "k", "r", True) for r in rows]
    out = pipeline.run(spark, written(spark, tmp_path, clash, ", kept string, rate string, keep boolean")).collect()
    want, texts = survivors(rows)
    assert {r.doc_id for r in out} == want
    for r in out:
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    copies = {i: sum(r.doc_id == i for r in out) for i in want}
    assert max(copies.values()) > 1  # scarce languages are repeated


def test_stages_keep_columns_and_null_ids(spark, tmp_path):
    import corpus_pipeline as pipeline

    rows = [(None, "one text without id", "en", "s", 1), (None, "one text without id", "en", "s", 1), (3, "another text", "de", None, None)]
    sf = written(spark, tmp_path, [(*r, 7) for r in rows], ", copies int")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert {r.copies for r in docs.collect()} == {7}
    kept = {(r.doc_id, r.text) for r in docs.collect()}
    assert kept == {(None, "one text without id"), (3, "another text")}


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    assert pipeline.run(spark, written(spark, tmp_path, [])).collect() == []
