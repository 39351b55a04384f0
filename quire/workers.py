"""Python workers: how they find this package where the driver's path isn't theirs."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> None:
    """Adds the package's folder to the workers' path; on a cluster the package comes with --py-files."""
    env = spark.sparkContext.environment
    known = [p for p in (env.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")) if p]
    if ROOT not in ":".join(known).split(":"):
        env["PYTHONPATH"] = ":".join([ROOT, *known[:1]])


def checkpointed(df: DataFrame) -> DataFrame:
    """df, kept in the folder that spark.checkpoint.dir names (in local mode, where that isn't set, one of this machine's)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quire-"))
    return df.checkpoint()
