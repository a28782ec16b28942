"""Answers of batch jobs: a durable ledger of what was submitted, and waves that submit, look and collect.

A job is the rows of one block of neighbouring indices. Submitting is a wave of its own whose
tasks commit the names of their jobs, so a crash loses no job; a task that died between a
submission and its commit finds the job again by its key. No task waits for a job: the
driver looks from time to time, and the rows of ended jobs are collected by another wave.
Invalid answers are submitted again, as often as the spec says.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.operators import donebits
from millrace.operators.annotate import AnnotateSpec, is_invalid, judged, on_wire, read_variants
from millrace.operators.progress import Progress, to_do
from millrace.plans.prepare import LENGTH_KEY
from millrace.sources.tables import delete

#: Rows of the ledger: the job that answers a row, the row's place in it, and how often the row was submitted before.
LEDGER = "idx long, job string, at int, attempt int"
POLL_SECONDS = 30.0


def run_batch_jobs(prepared: DataFrame, spec: AnnotateSpec, progress: Progress, scope: dict[str, str] | None = None, retry_errors: bool = False) -> None:
    """Submit what has no job, and collect until every row is done. Another call goes on where one stopped."""
    idx, error, scope = spec.idx_column, f"{spec.task_prefix}error", scope or {}
    if not donebits.countable(prepared, idx):
        raise ValueError("batch jobs need whole numbers as indices")
    prepared = prepared.drop(LENGTH_KEY)
    ledger = Progress(progress.spark, f"{progress.root}/jobs")
    look = bool(ledger.next_number())
    todo = to_do(prepared, progress, idx, error, retry_errors, scope)
    if retry_errors and (old := ledger.read()) is not None:
        # Rows that ended in an error have ended jobs; they are submitted once more.
        last = old.groupBy("idx").agg(F.max("attempt").alias("attempt"))
        failed = to_do(prepared, progress, idx, error, True, scope).join(to_do(prepared, progress, idx, error, False, scope).select(idx), idx, "left_anti")
        again = failed.join(last.withColumnRenamed("idx", "__idx"), F.col(idx) == F.col("__idx")).drop("__idx").withColumn("attempt", F.col("attempt") + 1)
        _submit(again, spec, ledger, look)
    known = ledger.read()
    fresh = todo if known is None else donebits.skip_set(todo, _written(donebits.merged(donebits.bitmaps(known, "idx")), progress), idx)
    _submit(fresh.withColumn("attempt", F.lit(0)), spec, ledger, look)
    pause = float(spec.provider.options.get("poll_seconds", POLL_SECONDS))
    while True:
        known = ledger.read()
        if known is None:
            break
        waiting = known.groupBy("idx").agg(F.max(F.struct("attempt", "job", "at")).alias("last")).select("idx", "last.*")
        asked = _written(to_do(prepared, progress, idx, error, retry_errors, scope).withColumnRenamed(idx, "__idx").join(waiting, F.col("__idx") == F.col("idx")).drop("idx").withColumnRenamed("__idx", idx), progress)
        jobs = asked.select("job").distinct()
        if jobs.isEmpty():
            break
        ended = _written(jobs.mapInArrow(_ended(spec), "job string, ended boolean"), progress).filter("ended").select("job")
        if ended.isEmpty():
            time.sleep(pause)
            continue
        schema = spec.output_schema_of(prepared)
        collected = T.StructType([*on_wire(schema).fields, T.StructField("__attempt", T.IntegerType()), T.StructField("__again", T.BooleanType())])
        rows = asked.join(ended, "job").repartition("job").sortWithinPartitions("job", "at")
        found = _written(rows.mapInArrow(_collector(spec, collected), collected), progress)
        number = progress.next_number()
        progress.append(read_variants(found.filter("not __again").drop("__attempt", "__again"), schema).withColumns({k: F.lit(v) for k, v in scope.items()}), number)
        progress.note_done(number, idx, error)
        again = found.filter("__again").select(F.col(idx).alias("__idx"), (F.col("__attempt") + 1).alias("attempt"))
        _submit(prepared.join(again, F.col(idx) == F.col("__idx")).drop("__idx"), spec, ledger, True)
        retry_errors = False
    delete(progress.spark, f"{progress.root}/todo")


def _written(df: DataFrame, progress: Progress) -> DataFrame:
    """A table written below the run's folder, so that it is made once and its size is known."""
    path = f"{progress.root}/todo/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _submit(rows: DataFrame, spec: AnnotateSpec, ledger: Progress, look: bool) -> None:
    """One job for each block of ``batch_size`` neighbouring indices; their names are committed task by task."""
    if rows.isEmpty():
        return
    slim = rows.select(F.col(spec.idx_column).cast("long").alias("idx"), F.col(f"{spec.task_prefix}messages").alias("messages"), "attempt", F.floor(F.col(spec.idx_column) / F.lit(spec.batch_size)).alias("block"))
    dealt = slim.repartition("attempt", "block").sortWithinPartitions("attempt", "block", "idx")
    ledger.append(dealt.mapInArrow(_submitter(spec, look), LEDGER))


def _submitter(spec: AnnotateSpec, look: bool):
    """Function for ``mapInArrow``: rows sorted by (attempt, block, idx) to the ledger's rows."""
    mark = json.dumps(spec.mark(), sort_keys=True, default=str)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, provider = TaskContext.get(), None
        seen = look or bool(context and context.attemptNumber())
        rows = (row for batch in batches for row in batch.to_pylist())
        try:
            for (attempt, _), block in groupby(rows, key=lambda r: (r["attempt"], r["block"])):
                block = list(block)
                provider = provider or spec.provider.build()
                options = spec.provider.runtime_options(provider, spec.schema)
                key = hashlib.sha256(json.dumps([mark, attempt, [r["idx"] for r in block], [r["messages"] for r in block]]).encode()).hexdigest()
                job = provider.submit([r["messages"] for r in block], options, spec.provider.extra, key, seen)
                n = len(block)
                yield pa.RecordBatch.from_arrays([pa.array([r["idx"] for r in block], pa.int64()), pa.array([job] * n), pa.array(range(n), pa.int32()), pa.array([attempt] * n, pa.int32())], ["idx", "job", "at", "attempt"])
        finally:
            if provider is not None:
                provider.close()

    return run


def _ended(spec: AnnotateSpec):
    """Function for ``mapInArrow``: jobs to whether each has ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with spec.provider.build() as provider:
            for batch in batches:
                jobs = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([provider.job_ended(j) for j in jobs], pa.bool_())], ["job", "ended"])

    return run


def _collector(spec: AnnotateSpec, schema: T.StructType):
    """Function for ``mapInArrow``: rows of ended jobs, sorted by (job, at), to judged rows; ``__again`` marks those to submit once more."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        with spec.provider.build() as provider:
            for job, block in groupby(rows, key=lambda r: r["job"]):
                block = list(block)
                answers = provider.job_results(job, 1 + max(r["at"] for r in block))
                out = []
                for row in block:
                    found = {**row, **judged(spec, row, answers[row["at"]])}
                    found["__attempt"], found["__again"] = row["attempt"], is_invalid(spec, found) and row["attempt"] < spec.num_retries_invalid
                    out.append(found)
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in out], f.type) for f in arrow], schema=arrow)

    return run
