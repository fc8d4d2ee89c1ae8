"""Every core query against its DuckDB counterpart at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

from codeloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_oracle(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    rel = oracle.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert got == want


def test_previews_of_all_files_cut_at_bytes(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.id: r.preview for r in catalogue.QUERIES["chunk_preview"](spark, SF).collect()}
    assert set(got) == set(texts)
    mark, cut = catalogue.T.PREVIEW_MARK, 0
    for i, text in texts.items():
        raw = (text or "").encode()
        if len(raw) <= catalogue.T.PREVIEW_BYTES + len(mark.encode()):
            assert got[i] == text
        else:
            cut += len(raw) != len(text)
            assert got[i] == raw[: catalogue.T.PREVIEW_BYTES].decode(errors="ignore").rstrip(" \t\n\v\f\r") + mark
    assert cut > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
