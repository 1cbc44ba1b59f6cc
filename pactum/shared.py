"""The folder that the driver and all executors reach."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a folder of our own, on one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        root = os.path.join(tempfile.gettempdir(), f"pactum-{os.getuid()}")
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    return root.rstrip("/")


def delete(spark: SparkSession, name: str) -> None:
    """Deletes a file or folder in any store that Spark reaches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
