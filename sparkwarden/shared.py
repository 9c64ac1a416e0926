"""Intermediate tables in the folder all executors share.

``spark.checkpoint.dir`` names that folder. Only a local session, whose single
machine runs everything, may do without it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{tempfile.gettempdir()}/sparkwarden"


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def kept(frame: DataFrame, purpose: str) -> DataFrame:
    """``frame`` written once and read back: later reads neither recompute it nor
    depend on the executors that made it."""
    path = new_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
