"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of the tables that a query deals to one task.
ROWS_A_TASK = 250_000


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library expects."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codeloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The session's folder for checkpoints; a temporary one serves local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="codeloom-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the session's shared folder; a temporary one serves local mode only."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows computed once, as a Parquet table in the shared folder: each use reads its columns only."""
    path = f"{_shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The same rows dealt by keys to tasks of about ``rows`` rows, at least one task a core."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, *keys)


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once, so that their Python needs no installation of it."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_codeloom_shipped", False) or not root.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="codeloom-package-")) / "codeloom_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    context._codeloom_shipped = True


def shares(spark: SparkSession, folder: str, *names: str) -> int:
    """How many tasks to deal the rows of some tables to, by the number of their rows; the session's number of shuffle partitions at least.

    Rows are counted from the files' footers. Dealing to a number that follows the rows keeps what one task holds.
    """
    rows = sum(table(spark, folder, name).count() for name in names)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))
