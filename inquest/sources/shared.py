"""Tables that driver and executors share, for results that must not be computed twice."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``; a local one is set where that is unset, on one
    machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="inquest-"))
        root = context._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/answers-{spark.sparkContext.applicationId}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back: it is computed once, whatever is lost later."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def workers_import(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package, and bound the bytes of their batches where the session
    doesn't."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
