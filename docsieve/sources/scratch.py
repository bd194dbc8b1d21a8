"""A folder that the driver and all executors share, for tables and files between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.

    Without that setting a session whose executors are threads of the driver gets a local
    one; any other raises, since its executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        base = "file://" + tempfile.mkdtemp(prefix="docsieve-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/docsieve-{uuid.uuid4().hex}"
