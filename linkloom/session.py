"""Where Python workers find this package, and where executors share files."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def ship(spark: SparkSession) -> None:
    """Workers on this machine find the package however the driver was started; on a cluster it comes by --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def place(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see. Where spark.checkpoint.dir is unset, one of this machine in local mode, as in tests,
    and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='linkloom-')}")
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
