"""Crash resume: what is still to do, as a batch anti join or as a file stream with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuslab.schema import assert_none


def pending(tasks: DataFrame, done: DataFrame, key: str = "sentence_id", same: tuple[str, ...] = ()) -> DataFrame:
    """Tasks whose key is not in the progress log. Columns in `same` must agree where both have the key."""
    for c in same:
        assert_none(tasks.join(done.select(key, F.col(c).alias("_c")), key).filter(~F.col(c).eqNullSafe(F.col("_c"))).select(key), f"{c} changed since the log")
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def process_new_files(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str | None = None, files_per_batch: int = 100) -> StreamingQuery:
    """Run `step` on records of files that came since the last run, and append the results; then stop.

    The checkpoint holds what was read, so a run that was killed goes on where it stood. With a key, a
    record whose key any earlier batch had is dropped (the state holds all keys, as a progress log does).
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_batch)).json(source)
    rows = rows.dropDuplicates([key]) if key else rows

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a crash replaces its own folder
        step(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
