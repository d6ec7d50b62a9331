"""Running streams: session settings, sources and sinks with checkpoints in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from storyspark.session import new_stage_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session on the same cluster for stateful streams.

    State is kept in RocksDB, off the heap. The number of state partitions is fixed for the life of a
    checkpoint, so it follows the cores of the cluster instead of a batch default.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return session


def read_files(session: SparkSession, folder: str, pattern: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream the parquet files of a folder that match ``pattern``; timestamps without zone become UTC."""
    schema = session.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = session.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.parquet(folder)
    zoneless = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def _trigger(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    """All that is there and then stop, or again and again in intervals such as ``1 minute``."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def run_available(df: DataFrame, spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """Process everything that is there, append the results to files and return them as a batch table.

    A ``folder`` that an earlier run used goes on from its checkpoint; without one a new folder is taken.
    """
    path = folder or new_stage_path(spark, name)
    stream = _trigger(
        df.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/_checkpoint").outputMode("append"), None
    ).start()
    stream.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/data")


def for_each_batch(df: DataFrame, spark: SparkSession, checkpoint: str, write: Callable[[DataFrame, int], None], every: str | None = None) -> None:
    """Hand every micro-batch to ``write``, which must tolerate a repeated batch.

    The checkpoint belongs beside what ``write`` writes: batch numbers go on from it when the stream is started again. With
    ``every`` the call returns only when the stream is stopped.
    """
    stream = _trigger(df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), every).start()
    stream.awaitTermination()
