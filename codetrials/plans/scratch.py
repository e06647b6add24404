"""A folder for tables that a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that the session names.

    A session on ``local`` that names none gets a temporary folder; on a cluster each executor would write to its own
    disk, so there it is an error.  Whoever sets ``spark.checkpoint.dir`` owns what lies below it: a result may be read
    after the query has returned, so nothing is removed here.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not root:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="codetrials-")
    return f"{root.rstrip('/')}/codetrials-{name}-{uuid.uuid4().hex}"
