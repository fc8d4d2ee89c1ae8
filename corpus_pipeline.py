"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

quality classifier -> exact dedup -> MinHash near-dedup -> mixing to target weights -> BPE digests.
The mixing stage emits a document as often as its rate says. Rates are 1 or more and the mix is made as
large as that takes, so it repeats scarce domains rather than dropping documents.

Every stage takes null texts as empty, null ids, repeated rows, other columns and empty tables, as the
operator's docstring says; rows of null ids are kept unless their text is a copy of another row's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from codeloom.llm.common import ensure_checkpoint_dir, kept_rows, release, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return kept_rows(docs, lambda d: quality.score(d, model), quality.OUTPUTS, "keep")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return near_dedup.near_dedup(docs)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their rates, all 1 or more, towards the target shares of languages."""
    mixed = mixing.mix(docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns}), mixing.TARGETS, domain_col="__own_lang", id_col="__own_doc_id", text_col="__own_text", budget=None, least=1.0)
    times = F.sequence(F.lit(1).cast("bigint"), "copies")
    return mixed.withColumn("__copy", F.explode(times)).select(*[F.col(f"__own_{c}").alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document."""
    return bpe.bpe_digest(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_languages),
    ("byte-level BPE encoding and decoding", encode),
]

#: A trained classifier and iterative fits cannot be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; intermediate tables go to the shared checkpoint folder.

    A stage's table is deleted once the next one is written; the last one stays for the caller.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        release(spark)
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
