"""Helpers that several operators share: table loading, lineage cuts and row keys."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the text contracts, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). In a local session without it, as in tests, a temporary one; elsewhere it must be set."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="pointloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


_scratch: list[tuple[SparkSession, str, str | None]] = []


def scratch(spark: SparkSession, name: str, table: bool = False) -> str:
    """A path in the shared folder for data that results read; drop_scratch removes it, and the table of this name if there is one."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    if not _scratch:
        atexit.register(drop_scratch)
    _scratch.append((spark, path, name if table else None))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop_scratch() -> None:
    """Remove all scratch data of this process; results that read it must have been used or written by then. Runs when Python ends."""
    while _scratch:
        spark, path, name = _scratch.pop()
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            continue  # a stopped session leaves its shared folder to whoever made it
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_keys(id_col: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that name a row by id and text. Rows equal in both share a key, and every per-row decision here depends on nothing else."""
    return F.xxhash64(F.lit(1), id_col, text), F.xxhash64(F.lit(2), id_col, text)


def sha_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def bound_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> None:
    """Python workers get at most so many rows and bytes at once (one row, if it is larger): texts are long, executors small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
