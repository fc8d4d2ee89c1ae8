"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z only, as the query contracts define lower-casing.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``; a temporary folder only in local mode.

    Raises RuntimeError on a cluster whose session names no shared folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="codeloom-checkpoint-")
    context.setCheckpointDir(shared)


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables of one run of an operator, in a folder of their own below the shared checkpoint folder.

    A written table cuts the lineage like a checkpoint, survives lost executors and is read column by
    column. Tables that nothing reads any more can be dropped; the others stay for the caller's plan.
    """

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoint_dir(spark)
        self.spark, self.folder = spark, f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` under a new name and return the table."""
        df.write.parquet(f"{self.folder}/{name}")
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that Spark's cleaner drops shuffles and broadcasts of finished steps.

    Without it they lie on the executors' disks until the driver's heap happens to fill.
    """
    gc.collect()
    spark._jvm.System.gc()


#: Rows in an Arrow batch: some megabytes of text, where Spark's 10,000 rows could be gigabytes.
BATCH_ROWS = 500


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows, which bounds a worker's memory.

    The setting belongs to the session and holds when the plan runs; a smaller one is left alone.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def text_or_empty(column: str) -> Column:
    """The text, with null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII texts take the JVM's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER)
    )


def replace_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop input columns that an operator is about to add under the same names."""
    return df.drop(*[c for c in df.columns if c in set(names)])


def kept_rows(docs: DataFrame, annotate: Callable[[DataFrame], DataFrame], outputs: list[str], flag: str) -> DataFrame:
    """The rows that ``annotate`` flags, with the columns of ``docs`` even where an output has their name."""
    aside = {c: f"__own_{c}" for c in docs.columns if c in outputs}
    flagged = annotate(docs.withColumnsRenamed(aside)).where(F.col(flag))
    return flagged.drop(*outputs).withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)
