"""Session settings for local runs; a cluster brings its own session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallychain")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # No call-site capture on every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, local_fallback: bool = False) -> str:
    """A new folder that every executor can reach, another one at each call.

    It lies in the folder the cluster names for checkpoints.  Where that is not set, a local
    session may use this machine's temporary folder, if the caller says so.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (local_fallback and spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.gettempdir()
    run = uuid.uuid4().hex
    return f"{folder.rstrip('/')}/tallychain/{spark.sparkContext.applicationId}/{run}"
