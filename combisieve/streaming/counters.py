"""Token counts and column profiles as Structured Streaming jobs.

State is one counter per key.  Each trigger writes only the keys that changed,
as its own partition; the latest counter of a key is the largest one.  A
compacted snapshot beside this log keeps what a reader needs in proportion to
the keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from combisieve.operators.profile import column_values
from combisieve.operators.tokens import token_counts


def read_arriving(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_token_counts(stream: DataFrame, tokens: Column | str, by: Sequence[str] = ()) -> DataFrame:
    return token_counts(stream, tokens, by)


def stream_column_profile(stream: DataFrame, features: str) -> DataFrame:
    return column_values(stream, features)


def run_counter(
    counts: DataFrame, path: str, available_now: bool = True, checkpoint: str | None = None, compact_every: int = 0,
    keys: Sequence[str] = (),
):
    """Start the query, or resume it: state and progress lie in ``checkpoint``,
    beside ``path`` unless named.  Each micro-batch overwrites its own folder, so
    a replay after a failure leaves the same files.  After every
    ``compact_every`` batches the log is compacted by ``keys``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact_counts(batch.sparkSession, path, keys, batch_id)

    writer = counts.writeStream.outputMode("update").foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint or f"{path}-checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _switched(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """``(last batch, folder)`` of the newest whole snapshot, or ``(-1, None)``."""
    try:
        newest = spark.read.schema("upto bigint, folder string").parquet(f"{path}-snapshots").agg(F.max(F.struct("upto", "folder")).alias("s")).first()["s"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None
    return (newest["upto"], newest["folder"]) if newest else (-1, None)


def _changes(spark: SparkSession, path: str, keys: Sequence[str], upto: int | None = None) -> tuple[DataFrame, str | None]:
    """The newest snapshot and the batches after it."""
    last, folder = _switched(spark, path)
    log = spark.read.parquet(path).filter(F.col("batch") > last)
    if upto is not None:
        log = log.filter(F.col("batch") <= upto)
    log = log.select(*keys, "n")
    return (log if folder is None else spark.read.parquet(folder).select(*keys, "n").unionByName(log)), folder


def compact_counts(spark: SparkSession, path: str, keys: Sequence[str], upto: int) -> str:
    """Write the counters after batch ``upto`` as a snapshot and switch to it.

    The snapshot is a folder of its own.  Only when it is whole, one row in
    ``<path>-snapshots`` names it: a file that is moved into place, so a reader
    sees the snapshot or the log, and a failure before leaves the log in force.
    The log is not touched; batches up to the second newest snapshot are not
    read any more and can be expired.
    """
    rows, _ = _changes(spark, path, keys, upto)
    folder = f"{path}-snapshot-{upto}-{uuid.uuid4().hex}"
    rows.groupBy(*keys).agg(F.max("n").alias("n")).write.parquet(folder)
    _switch(spark, path, upto, folder)
    return folder


def _switch(spark: SparkSession, path: str, upto: int, folder: str) -> None:
    spark.createDataFrame([(upto, folder)], "upto bigint, folder string").coalesce(1).write.mode("append").parquet(f"{path}-snapshots")


def latest_counts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The counters after the last trigger: one row per key of the snapshot and
    what later batches changed, whatever the number of batches before."""
    rows, _ = _changes(spark, path, keys)
    return rows.groupBy(*keys).agg(F.max("n").alias("n"))
