"""Annotation of growing sources: checkpointed micro-batches instead of progress files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.annotate import AnnotateSpec, annotate
from millrace.operators.tables import keep_first
from millrace.sources.tables import committed


def annotate_stream(source: DataFrame, spec: AnnotateSpec, path: str, checkpoint: str) -> None:
    """Annotate what is new in a stream of prepared rows and return once it is done.

    Each micro-batch overwrites its own folder, so one that runs again leaves no second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        annotate(batch, spec).write.mode("overwrite").parquet(f"{path}/batch={number}")

    source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_stream_results(spark: SparkSession, path: str, idx: str = "idx") -> DataFrame | None:
    """One row for each index, of the first committed micro-batch that has it."""
    batches = committed(spark, path, "batch=")
    if not batches:
        return None
    rows = spark.read.option("basePath", path).parquet(*batches)
    return keep_first(rows, [idx], ["batch"]).drop("batch")


def counts_stream(source: DataFrame, key: str, path: str, checkpoint: str) -> None:
    """Counts by key of what is new, one folder a micro-batch; ``total_counts`` adds them up."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def total_counts(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*committed(spark, path, "batch=")).groupBy(key).agg(F.sum("n").alias("n"))
