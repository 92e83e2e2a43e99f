"""Session settings that every query of the engine relies on."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC and let Python workers import this package from where the driver has it.

    A cluster whose executors lack that path takes the package through ``--py-files``.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for working tables: in the cluster's shared spark.checkpoint.dir, or, where that is unset and all runs on one machine, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidewell-')}"
    return f"{root.rstrip('/')}/tidewell/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
