"""What keeps queries whole on large tables: how the work is dealt out, and what is broadcast or done again."""

from __future__ import annotations

import re

import pytest

from codeloom import session
from codeloom.plans import catalogue, code_catalogue

SF = "/root/testdata/sf0.001"


def first_plan(df) -> str:
    """The plan before any statistics of a run."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_modules_are_dealt_out_by_number(spark, monkeypatch):
    assert code_catalogue.code_files(spark, SF).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism  # modules and tests
    monkeypatch.setattr(code_catalogue, "MODULES_A_TASK", 10)
    n = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert code_catalogue.code_files(spark, SF).rdd.getNumPartitions() == 2 * -(-n // 10)


@pytest.mark.parametrize("name", ["code_clear_file", "code_edge_labels", "code_edges_derived", "code_edges_raw", "code_imports_of", "code_definition_at", "code_chunks", "code_symbol_calls"])
def test_generated_sources_are_not_broadcast(spark, name):
    plan = first_plan(catalogue.QUERIES[name](spark, SF))
    small = "LeftSemi, BuildRight" if name == "code_imports_of" else "nothing"  # the node of its one file
    assert "SortMergeJoin" in plan and not [line for line in plan.split("\n") if "BroadcastHashJoin" in line and small not in line]


@pytest.mark.parametrize("name", ["code_clear_file", "code_definition_at", "code_edges_raw", "code_nodes", "code_symbol_calls"])
def test_facts_read_more_than_once_are_parsed_once(spark, name):
    assert "MapInPandas" not in first_plan(catalogue.QUERIES[name](spark, SF))


@pytest.mark.parametrize(("name", "keys"), [("brief_counts", ["source_id"]), ("definition_at", ["file_id"]), ("integrity_report", ["source_id", "id"])])
def test_graph_is_dealt_to_tasks_by_its_rows(spark, monkeypatch, name, keys):
    monkeypatch.setattr(session, "ROWS_A_TASK", 200)
    rows = sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("orders", "lineitem"))
    plan = first_plan(catalogue.QUERIES[name](spark, SF))
    for key in keys:
        assert re.search(rf"hashpartitioning\({key}#\d+L?, {-(-rows // 200)}\), REPARTITION_BY_NUM", plan), key


@pytest.mark.parametrize("name", ["definition_at", "calls_in_symbol"])
def test_symbols_and_places_are_dealt_by_their_rows_in_every_shuffle(spark, monkeypatch, name):
    monkeypatch.setattr(session, "ROWS_A_TASK", 200)
    rows = sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("orders", "lineitem"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as on tables too large for it
    try:
        plan = first_plan(catalogue.QUERIES[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert re.findall(r"hashpartitioning\((?:file_id|l_orderkey|o_orderkey)#\d+L?, (\d+)\)", plan) == [str(-(-rows // 200))] * plan.count("Exchange hashpartitioning")
