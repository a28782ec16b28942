"""Durable progress: rows are committed task by task, and what is made of them."""

from __future__ import annotations

import json
import logging
import platform
import uuid
from contextlib import ExitStack
from dataclasses import dataclass, field, replace
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import donebits, wave_stats
from millrace.operators.annotate import AnnotateSpec, annotate, batched, in_flight
from millrace.operators.open_answers import merged_schemas, shared_schema
from millrace.operators.tables import done_rows, keep_first, metadata_counts, skip_done
from millrace.plans.prepare import LENGTH_KEY, assign_index
from millrace.providers.leases import LeaseBroker, driver_host
from millrace.sources.tables import delete, exists, has_files, list_files, read_text, remove_empty_files, write_text

log = logging.getLogger("millrace.progress")
#: Rows that one task answers and commits; a crash costs the rows of the running tasks.
TASK_ROWS = 1000
#: Tasks of a wave for each task slot of the cluster, so that its last tasks hold up little.
TASKS_PER_SLOT = 32
ROWS_PER_FILE = 1000
#: Columns of a wave that are no results.
STAMPS = ("wave", "written_at", "seq", "dataset_split", "dataset_config")
SCOPE = ("dataset_split", "dataset_config")


@dataclass(frozen=True)
class Progress:
    """Annotated rows below ``root``, a folder a wave.

    A wave is one job. It is named in a manifest before it begins, and each of its tasks
    commits its files when it ends, so the rows of finished tasks count whatever becomes of
    the job. A wave that ended has bitmaps of its rows beside it. With a backup, waves are
    copied there too: each one, or once ``backup_every`` rows have gathered.
    """

    spark: SparkSession
    root: str
    backup: str | None = None
    rows_per_file: int = ROWS_PER_FILE
    backup_every: int = 0
    _pending: list = field(default_factory=list, compare=False, repr=False)

    @property
    def path(self) -> str:
        return f"{self.root}/progress"

    def exists(self, root: str | None = None) -> bool:
        return bool(self.waves(root or self.root))

    def _named(self, root: str) -> list[str]:
        return [name.rsplit("/", 1)[1] for name, _ in list_files(self.spark, f"{root}/manifest")]

    def waves(self, root: str) -> list[str]:
        """Folders of the waves of which a task was committed."""
        folders = [f"{root}/progress/wave={name}" for name in self._named(root)]
        return [f for f in folders if has_files(self.spark, f, ".parquet")]

    def read(self) -> DataFrame | None:
        """All committed rows, from the backup where there are none here. Waves may differ in columns."""
        root = self.root if self.exists() else self.backup
        waves = self.waves(root) if root else []
        return self.spark.read.option("basePath", f"{root}/progress").option("mergeSchema", "true").parquet(*waves) if waves else None

    def next_number(self) -> int:
        """One above the last wave's, so an earlier wave's rows come first."""
        return 1 + max(map(int, self._named(self.root)), default=-1)

    def append(self, rows: DataFrame, number: int | None = None) -> None:
        """Write a wave. Files of a task are moved to their place when it is committed, not when the job is."""
        number = self.next_number() if number is None else number
        stamped = rows.withColumn("written_at", F.current_timestamp()).withColumn("seq", F.monotonically_increasing_id())
        target = f"{self.path}/wave={number:08d}"
        write_text(self.spark, f"{self.root}/manifest/{number:08d}", "")
        writer = stamped.write.mode("append").option("maxRecordsPerFile", self.rows_per_file)
        writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(target)
        if self.backup:
            self._pending.append((number, self.spark.read.parquet(target).count() if self.backup_every else 0))
            if sum(n for _, n in self._pending) >= self.backup_every:
                self.copy_pending()

    def copy_pending(self) -> None:
        """Copy the waves that the backup does not have yet, those of earlier runs as well."""
        if self.backup and self._named(self.root):
            there = set(self._named(self.backup))
            for folder in self.waves(self.root):
                name = folder.rsplit("=", 1)[1]
                if name not in there:
                    self.spark.read.parquet(folder).write.mode("overwrite").parquet(f"{self.backup}/progress/wave={name}")
                    write_text(self.spark, f"{self.backup}/manifest/{name}", "")
        self._pending.clear()

    def note_done(self, number: int, idx: str, error: str) -> None:
        """Keep the bitmaps of a wave that ended; later runs read them in place of its rows."""
        folder = f"{self.path}/wave={number:08d}"
        if has_files(self.spark, folder, ".parquet"):
            rows = self.spark.read.parquet(folder)
            if donebits.countable(rows, idx):
                _bits(rows, idx, error).write.mode("overwrite").parquet(f"{self.root}/done/wave={number:08d}")
            prefix = error.removesuffix("error")
            if f"{prefix}num_tokens" in rows.columns:
                wave_stats.wave_stats(rows, prefix).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/stats/wave={number:08d}")
            for f in rows.schema.fields:
                if isinstance(f.dataType, T.VariantType):
                    write_text(self.spark, f"{self.root}/open/{f.name}/{number:08d}", shared_schema(rows, f.name))

    def stats(self) -> DataFrame | None:
        """Counts and token sketch over all waves that ended, merged from what each left; no row is read.

        Each answer counts, also one that a retry replaced later.
        """
        names = [n for n in self._named(self.root) if exists(self.spark, f"{self.root}/stats/wave={n}/_SUCCESS")]
        return wave_stats.read_stats(self.spark, [f"{self.root}/stats/wave={n}" for n in names])

    def open_schema(self, column: str) -> str:
        """What the keys beyond the schema hold, over all waves that ended."""
        return merged_schemas([read_text(self.spark, f) for f, _ in list_files(self.spark, f"{self.root}/open/{column}")])

    def done_bits(self, idx: str, error: str, good: bool, scope: dict[str, str]) -> DataFrame | None:
        """Merged bitmaps (bucket, bits) of the done rows, staged; None where indices have no bits.

        Bitmaps of ended waves are read as they are, those of others are made from their rows.
        """
        root = self.root if self.exists() else self.backup
        found: DataFrame | None = None
        waves = self.waves(root) if root else []
        known = [w for w in waves if exists(self.spark, f"{root}/done/{w.rsplit('/', 1)[1]}/_SUCCESS")]
        others = [w for w in waves if w not in known]
        if others:
            rows = self.spark.read.option("basePath", f"{root}/progress").option("mergeSchema", "true").parquet(*others)
            if not donebits.countable(rows, idx):
                return None
            found = _bits(rows, idx, error)
        if known:
            maps = self.spark.read.parquet(*[f"{root}/done/{w.rsplit('/', 1)[1]}" for w in known])
            found = maps if found is None else found.unionByName(maps)
        if found is None:
            return None
        for column, value in scope.items():
            found = found.filter(F.col(column).isNull() | (F.col(column) == value))
        path = f"{self.root}/todo/bits-{uuid.uuid4().hex}"
        donebits.merged(found, "good" if good else "done").write.parquet(path)
        return self.spark.read.parquet(path)

    def clear(self) -> None:
        for name in ("manifest", "progress", "done", "stats", "open", "jobs", "todo"):
            delete(self.spark, f"{self.root}/{name}")


def _bits(rows: DataFrame, idx: str, error: str) -> DataFrame:
    scoped = rows.withColumns({c: F.lit(None).cast("string") for c in SCOPE if c not in rows.columns})
    return donebits.bitmaps(scoped, idx, error if error in rows.columns else None, SCOPE)


def import_jsonl(spark: SparkSession, folder: str, schema: T.StructType, idx: str = "idx") -> DataFrame:
    """Rows of older progress files. A bad last line of a file is left out; one before it is an error, as is a missing index.

    Lines are checked where they are read; what is gathered is one bad line at most.
    """
    remove_empty_files(spark, folder)
    if not list_files(spark, folder, ".jsonl"):
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(f"{folder}/*.jsonl").select("value", F.col("_metadata.file_path").alias("file"), at.alias("at"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", "allowSingleQuotes": "false"}
    parsed = lines.filter(F.trim("value") != "").withColumn("row", F.from_json("value", full, options))
    bad = F.col("row").isNull() | F.col("row.__bad").isNotNull()
    last = parsed.groupBy("file").agg(F.max("at").alias("last"))
    wrong = parsed.filter(bad | F.col(f"row.{idx}").isNull()).join(last, "file").filter(~bad | (F.col("at") < F.col("last")))
    first = wrong.orderBy("file", "at").select("file", "at", bad.alias("bad")).first()
    if first is not None:
        number = lines.filter((F.col("file") == first.file) & (F.col("at") <= F.struct(F.lit(first["at"].block).alias("block"), F.lit(first["at"].line).alias("line")))).count()
        raise ValueError(f"{first.file}: line {number} is not JSON" if first.bad else f"{first.file}: line {number} has no {idx!r}")
    if not parsed.filter(bad).isEmpty():
        log.warning("%s: the cut last line of a file is left out", folder)
    return parsed.filter(~bad).select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields])


def to_do(prepared: DataFrame, progress: Progress, idx: str, error: str, retry_errors: bool = False, scope: dict[str, str] | None = None) -> DataFrame:
    """Prepared rows that no committed task has answered; with ``retry_errors`` those that ended in an error as well."""
    scope = scope or {}
    if not progress.exists() and not (progress.backup and progress.exists(progress.backup)):
        return prepared
    if donebits.countable(prepared, idx) and (bits := progress.done_bits(idx, error, retry_errors, scope)) is not None:
        return donebits.skip_set(prepared, bits, idx)
    return skip_done(prepared, done_rows(progress.read(), idx, error if retry_errors else None, **scope), idx)


def run_annotation(
    prepared: DataFrame,
    spec: AnnotateSpec,
    progress: Progress,
    wave_rows: int | None = None,
    overwrite: bool = False,
    partitions: int | None = None,
    retry_errors: bool = False,
    max_waves: int | None = None,
    dataset_split: str | None = None,
    dataset_config: str | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Annotate what is not done and return the final table.

    Rows are dealt to tasks of ``task_rows`` neighbouring rows, or to ``partitions`` tasks, and
    each task's answers are durable when it ends. A wave is as many tasks as keep the cluster
    busy for long (``wave_rows`` sets its rows); what is to do is written once, a folder a wave,
    where there are several. Rows that are done are left out by their bits before the model
    is asked; with a split or configuration named, only progress of the same one counts.
    Several servers lease their places to all tasks together.
    """
    idx, scope = spec.idx_column, {"dataset_split": dataset_split, "dataset_config": dataset_config}
    scope, error = {k: v for k, v in scope.items() if v is not None}, f"{spec.task_prefix}error"
    if overwrite:
        progress.clear()
    progress.copy_pending()
    if spec.provider.options.get("batch_api"):
        from millrace.operators.batch_jobs import run_batch_jobs

        run_batch_jobs(prepared, spec, progress, scope, retry_errors)
    todo = to_do(prepared, progress, idx, error, retry_errors and not spec.provider.options.get("batch_api"), scope)
    slots = max(1, progress.spark.sparkContext.defaultParallelism)
    if wave_rows is None:
        wave_rows = progress.backup_every or task_rows * TASKS_PER_SLOT * slots
    number, servers = progress.next_number(), len(spec.provider.base_urls)
    with ExitStack() as stack:
        if servers > 1:
            places = in_flight(spec.queue_size, servers)
            broker = stack.enter_context(LeaseBroker(servers, max(1, places // servers), driver_host(progress.spark)))
            spec = replace(spec, leases=broker.address)
        for wave, rows, bounds in _waves(todo, idx, wave_rows, progress, max_waves):
            # At least as many tasks as there are slots, if each still has a batch.
            tasks = partitions or max(-(-rows // task_rows), min(slots, -(-rows // spec.batch_size)), 1)
            if spec.together:
                tasks = min(tasks, slots)  # they run at one time
            if LENGTH_KEY in wave.columns:
                # Prompts of like length meet in a batch, and each task gets whole batches.
                wave = batched(assign_index(wave, [LENGTH_KEY, idx], "__rank"), "__rank", spec.batch_size, "__rank", tasks).drop("__rank", LENGTH_KEY)
            elif tasks > 1 or partitions or spec.together:
                wave = _neighbours(wave, idx, tasks, bounds)
            asked = replace(spec, pool_tasks=min(slots, tasks)) if servers > 1 else spec
            progress.append(annotate(wave, asked).withColumns({k: F.lit(v) for k, v in scope.items()}), number)
            progress.note_done(number, idx, error)
            number += 1
    progress.copy_pending()
    delete(progress.spark, f"{progress.root}/todo")
    found = progress.read()
    if found is None:
        progress.append(annotate(prepared.drop(LENGTH_KEY).limit(0), spec))
        found = progress.read()
    for column, value in scope.items():
        if column in found.columns:
            found = found.filter(F.col(column).isNull() | (F.col(column) == value))
    return finalized(found, idx, error)


def _neighbours(wave: DataFrame, idx: str, tasks: int, bounds: tuple[int, int] | None) -> DataFrame:
    """Rows dealt to so many tasks by equal ranges of the index, so a file's bits lie in few buckets; by hash if it is no number."""
    if bounds is None or not donebits.countable(wave, idx):
        return wave.repartition(tasks, idx)
    low, high = bounds
    width = -(-(high - low + 1) // tasks)
    place = F.coalesce(F.floor((F.col(idx) - F.lit(low)) / F.lit(width)), F.lit(0)).cast("int")
    return wave.withColumn("__task", place).repartitionById(tasks, F.col("__task")).drop("__task")


def _waves(todo: DataFrame, idx: str, wave_rows: int, progress: Progress, most: int | None):
    """(rows, their number, least and largest index if known) of each wave in turn, in order of the prepared rows."""
    order = LENGTH_KEY if LENGTH_KEY in todo.columns else idx
    range_of = todo.agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high")).first()
    if not range_of.n:
        return
    waves = -(-range_of.n // wave_rows)
    ranged = order == idx and donebits.countable(todo, idx)
    if waves == 1 and most is None:
        yield todo, range_of.n, (range_of.low, range_of.high) if ranged else None
        return
    if ranged:
        # Equal ranges of the index, which is unique: a wave holds its width in rows at most.
        width = -(-(range_of.high - range_of.low + 1) // waves)
        cut = todo.withColumn("__wave", F.floor((F.col(idx) - F.lit(range_of.low)) / F.lit(width)).cast("int"))
    else:
        cut = assign_index(todo, list(dict.fromkeys([order, idx])), "__at").withColumn("__wave", F.floor(F.col("__at") / wave_rows).cast("int")).drop("__at")
    path = f"{progress.root}/todo/{uuid.uuid4().hex}"
    # A wave's rows are gathered by as many tasks as there are slots, so it has few files and not one for each task there is.
    slots = max(1, progress.spark.sparkContext.defaultParallelism)
    dealt = cut.repartition("__wave", F.pmod(F.xxhash64(idx), F.lit(min(slots, -(-wave_rows // ROWS_PER_FILE)))))
    dealt.write.partitionBy("__wave").option("maxRecordsPerFile", ROWS_PER_FILE * 10).parquet(path)
    for k in range(waves if most is None else min(waves, most)):
        if list_files(progress.spark, f"{path}/__wave={k}"):
            wave = progress.spark.read.schema(todo.schema).parquet(f"{path}/__wave={k}")
            first = range_of.low + k * width if ranged else 0
            yield wave, min(wave_rows, range_of.n), (first, first + width - 1) if ranged else None


def finalized(rows: DataFrame, idx: str = "idx", error: str = "error") -> DataFrame:
    """One row for each index, in order of the index: the first written without an error, else the first."""
    order = [F.col(error).isNotNull()] if error in rows.columns else []
    first = keep_first(rows, [idx], [*order, "wave", "written_at", "seq"])
    return first.drop(*STAMPS).orderBy(idx)


def versions() -> dict[str, str]:
    """Versions of what made a table."""

    def version(name: str) -> str:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return "not installed"

    return {"python": platform.python_version(), **{n: version(n) for n in ("pyspark", "pyarrow", "pandas", "numpy")}}


def write_metadata(df: DataFrame, root: str, prefix: str = "", extra: dict | None = None) -> dict:
    """Write and return versions and counts of a final table."""
    counts: dict[str, dict[str, int]] = {}
    for r in metadata_counts(df, prefix).collect():
        counts.setdefault(r.what, {})[r.value] = r.n
    found = {"versions": versions(), "num_rows": df.count(), "counts": counts, **(extra or {})}
    write_text(df.sparkSession, f"{root}/{prefix}metadata.json", json.dumps(found, indent=2, sort_keys=True, default=str))
    return found


def write_final(df: DataFrame, path: str, backup: str | None = None, rows_per_file: int = 0) -> DataFrame:
    """Write the final table, and a copy to the backup; read it back."""
    for place in filter(None, [path, backup]):
        df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(place)
    return df.sparkSession.read.parquet(path)


