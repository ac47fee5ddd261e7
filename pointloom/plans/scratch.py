"""The folder that driver and executors share, and scratch paths in it."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. In a local session without it, as in tests, a temporary folder; elsewhere it must be set."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="pointloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/pointloom-{name}-{uuid4().hex}"
