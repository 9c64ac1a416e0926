"""Streams of event files, and tables that streams are written to.

A feed is a folder that files are added to. A stream is run with the available-now
trigger: it takes what has come since its last run, in several micro-batches, and stops;
its checkpoint lies in the shared folder, so a lost executor or a later run goes on where
the checkpoint ends, and the sink's log lists each batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sparkwarden.shared import new_folder

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure_streaming(spark: SparkSession) -> SparkSession:
    """State on local disk with changes logged to the checkpoint: it may outgrow memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


def event_feed(spark: SparkSession, path: str, schema: StructType, files: int = 1000) -> DataFrame:
    """The Parquet files of a folder as a stream, at most ``files`` in one micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def started(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to a Parquet table what has come, then ends."""
    configure_streaming(rows.sparkSession)
    sink = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return sink.outputMode("append").trigger(availableNow=True).start()


def caught_up(rows: DataFrame, purpose: str) -> DataFrame:
    """``rows`` run to the end of what has come, in a new table and checkpoint."""
    spark = rows.sparkSession
    path = new_folder(spark, purpose)
    started(rows, path, new_folder(spark, f"{purpose}-checkpoint")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)
