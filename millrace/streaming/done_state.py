"""Streams that ask for each index once: a state store keyed by index in front of the model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.annotate import AnnotateSpec, annotate


def unseen(source: DataFrame, idx: str = "idx", delay: str | None = None, at: str | None = None) -> DataFrame:
    """Rows of a stream whose index no earlier row had, told by Spark's state store.

    The state holds indices only and lives in the query's checkpoint, so a restart knows
    what was seen. It grows with the indices; with a time column ``at`` and a ``delay`` those older than the
    watermark are forgotten, and rows that come later than that are dropped.
    """
    if delay is not None:
        return source.withWatermark(at, delay).dropDuplicatesWithinWatermark([idx])
    return source.dropDuplicates([idx])


def annotate_once(source: DataFrame, spec: AnnotateSpec, path: str, checkpoint: str, delay: str | None = None, at: str | None = None) -> None:
    """Annotate the rows of a stream whose index is new, and return once all there is has been read.

    The model stands behind the state: a row that the source repeats, in this micro-batch, a later one or
    after a restart, is dropped before it is asked. The file sink commits a micro-batch
    whole, and one that runs again after a crash takes the place of its first attempt.
    """
    answered = annotate(unseen(source, spec.idx_column, delay, at), spec)
    query = answered.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    query.trigger(availableNow=True).start().awaitTermination()


def answered_counts(source: DataFrame, spec: AnnotateSpec, key: str, path: str, checkpoint: str) -> None:
    """Counts of answers by a kept column, of each index once, kept up to date over restarts; ``path`` holds the last state of each micro-batch."""
    counts = annotate(unseen(source, spec.idx_column), spec).groupBy(key).agg(F.count("*").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
