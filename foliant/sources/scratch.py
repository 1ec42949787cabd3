"""Where jobs put tables of their own: the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, label: str) -> str:
    """A path that no other table has, in spark.checkpoint.dir; where that is unset, in a new local folder, but only where driver
    and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="foliant-"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/foliant/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
