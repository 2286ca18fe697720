"""Incremental jobs: what has arrived is processed once, with exactly the results of a batch run over all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_available(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str) -> None:
    """Process the files of ``source`` that have not been processed, append rows whose key the sink lacks, and stop.

    The checkpoint makes a file's batch run once; the anti-join makes a batch that is repeated after a failure add nothing twice.
    """

    def one(batch: DataFrame, _id: int) -> None:
        out = work(batch).dropDuplicates([key])
        try:  # only the sink's keys are read, and only those of the batch go on
            done = spark.read.parquet(sink).select(key)
        except Exception as e:  # noqa: BLE001 - the first batch has no sink yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            out = out.join(done, key, "left_anti")
        out.write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).json(source)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and kind; on a stream, rows later than ``late`` are left out of closed windows."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n", "total")
