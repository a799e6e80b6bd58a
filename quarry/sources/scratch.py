"""A shared folder for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_KEY = "spark.checkpoint.dir"
_made_up: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, below a temporary folder on a single machine, and
    an error on a cluster."""
    sc = spark.sparkContext
    base = spark.conf.get(_KEY, None) or sc.getConf().get(_KEY) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        if sc.applicationId not in _made_up:
            _made_up[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="quarry-")
        base = _made_up[sc.applicationId]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
