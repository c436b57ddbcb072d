"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below spark.checkpoint.dir; a private one only where all runs in one process and none is set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="codeloom-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/codeloom-{tag}-{uuid.uuid4().hex}"
