"""The annotate operator: prompts to validated answers inside Arrow batches."""

from __future__ import annotations

import inspect
import json
import logging
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.identity import code_mark
from millrace.functions.schemas import as_schema, fitted, property_fields
from millrace.operators.open_answers import as_variant, plain
from millrace.providers import Provider, ProviderSpec, Response
from millrace.providers.leases import LeaseAddress, Leases
from millrace.providers.pool import ServerPool

log = logging.getLogger("millrace.annotate")
RETRIES = 5
BATCH_SIZE = 256


@dataclass(frozen=True)
class AnnotateSpec:
    """How answers are made and judged. Callables and the provider's spec are shipped to workers."""

    provider: ProviderSpec
    output_schema: dict | str | None = None
    task_prefix: str = ""
    idx_column: str = "idx"
    keep_columns: tuple[str, ...] | bool = ()
    batch_size: int = BATCH_SIZE
    num_retries_invalid: int = RETRIES
    validate: Callable[[dict], bool] | None = None
    postprocess: Callable[[dict], dict] | None = None
    #: Columns that ``postprocess`` adds, as a DDL string.
    extra_columns: str = ""
    #: Whether rows of a schema without required keys are valid.
    null_validity_is_ok: bool = False
    prompt_prefix: str = ""
    system: str | None = None
    verbose: bool = False
    #: Batches in flight over a pool of servers, and the tasks that share them.
    queue_size: int | None = None
    pool_tasks: int = 1
    #: What a task needs of its executor, such as ``{"gpu": 1}``; Spark places tasks by it.
    task_resources: dict[str, float] | None = None
    #: Whether all tasks begin together, and none asks before all engines are warm.
    together: bool = False
    #: Where tasks lease places at servers, while a run serves them.
    leases: LeaseAddress | None = None
    schema: dict | None = field(init=False, default=None)
    #: Columns of the schema's properties, found once.
    fields: tuple[T.StructField, ...] = field(init=False, default=(), repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "schema", as_schema(self.output_schema))
        object.__setattr__(self, "fields", tuple(property_fields(self.schema)) if self.schema is not None else ())
        if self.batch_size < 1 or self.num_retries_invalid < 0:
            raise ValueError("batch_size must be 1 or more, num_retries_invalid 0 or more")

    def result_fields(self) -> list[T.StructField]:
        """Columns that the operator adds, in order."""
        p, text = self.task_prefix, T.StringType()
        out = [T.StructField(f"{p}response", text), T.StructField(f"{p}finish_reason", text), T.StructField(f"{p}num_tokens", T.IntegerType()), T.StructField(f"{p}error", text), T.StructField(f"{p}error_type", text)]
        if self.schema is not None:
            out += [T.StructField(f"{p}valid_fields", T.BooleanType()), *self.fields, T.StructField(f"{p}extra", T.VariantType())]
        if self.extra_columns:
            out += T.StructType.fromDDL(self.extra_columns).fields
        if self.validate is not None:
            out.append(T.StructField(f"{p}valid", T.BooleanType()))
        return out

    def mark(self) -> dict[str, Any]:
        """What the answers depend on, as plain data: model and options, schema, hooks and retries, but no servers and no secrets."""
        provider = self.provider
        factory = provider.factory if isinstance(provider.factory, str) else code_mark(provider.factory)
        asked = {"provider": factory, "model": provider.model, "options": code_mark(provider.options), "extra": code_mark(provider.extra)}
        judged = {"schema": self.schema, "validate": code_mark(self.validate), "postprocess": code_mark(self.postprocess), "extra_columns": self.extra_columns}
        return {**asked, **judged, "retries": self.num_retries_invalid, "null_validity_is_ok": self.null_validity_is_ok}

    def output_schema_of(self, df: DataFrame) -> T.StructType:
        """Kept input columns, then results; a result takes the place of an input of its name."""
        messages = f"{self.task_prefix}messages"
        results = {f.name: f for f in self.result_fields()}
        kept = [f for f in df.schema.fields if self.keep_columns is True or f.name in (self.idx_column, messages) or f.name in (self.keep_columns or ())]
        kept = sorted(kept, key=lambda f: (f.name == messages, f.name != self.idx_column))
        return T.StructType([*(f for f in kept if f.name not in results), *results.values()])


def parsed(spec: AnnotateSpec, r: Response) -> dict[str, Any]:
    """Result columns of one response."""
    p = spec.task_prefix
    row: dict[str, Any] = {f"{p}response": r.text, f"{p}finish_reason": r.stop_reason, f"{p}num_tokens": r.num_output_tokens, f"{p}error": r.error, f"{p}error_type": r.error_type}
    if spec.schema is None:
        return row
    fields = spec.fields
    row |= {f"{p}valid_fields": False, f"{p}extra": None} | dict.fromkeys([f.name for f in fields])
    if r.error is not None:
        return row
    try:
        value = json.loads(r.text)
    except ValueError:
        return row
    if not isinstance(value, dict):
        return row
    required = spec.schema.get("required")
    whole = all(k in value for k in required) if required else None
    for f in fields:
        row[f.name] = fitted(value.pop(f.name, None), f.dataType)
    row[f"{p}extra"] = json.dumps(plain(value), ensure_ascii=False) if value else None
    row[f"{p}valid_fields"] = whole
    return row


def judged(spec: AnnotateSpec, source: dict, r: Response) -> dict[str, Any]:
    """Parsed, postprocessed and validated result of one row."""
    row, p = parsed(spec, r), spec.task_prefix
    if spec.postprocess is not None and r.error is None:
        row = spec.postprocess({**source, **row})
        if not isinstance(row, dict):
            raise TypeError(f"postprocess must return a dict, not {type(row).__name__}")
    if spec.validate is not None:
        ok = r.error is None and row.get(f"{p}valid_fields") is not False
        if ok:
            ok = spec.validate({**source, **row})
            if not isinstance(ok, bool):
                raise TypeError(f"validate must return a bool, not {type(ok).__name__}")
        row[f"{p}valid"] = ok
    return row


def is_invalid(spec: AnnotateSpec, row: dict) -> bool:
    """Whether a row is tried again: a falsy verdict; a null one too, unless the spec says otherwise."""
    p = spec.task_prefix
    if spec.validate is not None and not row[f"{p}valid"]:
        return True
    if spec.schema is None:
        return False
    fields = row.get(f"{p}valid_fields")
    return fields is False or (fields is None and not spec.null_validity_is_ok)


def annotate_rows(spec: AnnotateSpec, provider: Provider, rows: list[dict]) -> list[dict]:
    """One batch with its retries; results stand in the order of the rows."""
    options = spec.provider.runtime_options(provider, spec.schema)

    def ask(which: list[int]) -> list[dict]:
        found = provider.batch([rows[k][f"{spec.task_prefix}messages"] for k in which], options, **spec.provider.extra)
        if len(found) != len(which):
            raise ValueError(f"{provider.name} gave {len(found)} answers to {len(which)} prompts")
        return [judged(spec, rows[k], r) for k, r in zip(which, found)]

    done = ask(list(range(len(rows))))
    for _ in range(spec.num_retries_invalid):
        again = [k for k, row in enumerate(done) if is_invalid(spec, row)]
        if not again:
            break
        for k, row in zip(again, ask(again)):
            done[k] = row
    if spec.verbose and done and all(is_invalid(spec, row) for row in done):
        log.warning("all %d rows of a batch are invalid", len(done))
    return done


def resized(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``size``, in whatever batches Arrow hands them over; only a task's last one may be shorter."""
    parts: list[pa.RecordBatch] = []
    missing = size
    for batch in batches:
        while batch.num_rows:
            parts.append(batch.slice(0, missing))
            batch, missing = batch.slice(parts[-1].num_rows), missing - parts[-1].num_rows
            if not missing:
                yield pa.concat_batches(parts)
                parts, missing = [], size
    if parts:
        yield pa.concat_batches(parts)


def worker(spec: AnnotateSpec, schema: T.StructType):
    """Function for ``mapInArrow``; providers are built, warmed up and closed in the task.

    A pool of servers answers several batches at a time, in order of completion; a single
    provider answers one after another.
    """
    arrow = to_arrow_schema(schema)

    def warmed(provider: Provider) -> Provider:
        if spec.prompt_prefix:
            provider.warm_up(spec.prompt_prefix, spec.system, spec.provider.runtime_options(provider, spec.schema))
        return provider

    # Only what hooks and the provider read becomes Python objects; kept columns stay as they are.
    hooked = spec.validate is not None or spec.postprocess is not None
    results_of = {f.name for f in spec.result_fields()}
    messages = f"{spec.task_prefix}messages"

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
        for part in resized(batches, spec.batch_size):
            yield part, (part if hooked else part.select([messages])).to_pylist()

    def merged(part: pa.RecordBatch, rows: list[dict], results: list[dict]) -> pa.RecordBatch:
        def column(f: pa.Field) -> pa.Array:
            if f.name not in results_of and spec.postprocess is None:
                return part.column(f.name).cast(f.type)
            return pa.array([r[f.name] if f.name in r else row.get(f.name) for row, r in zip(rows, results)], f.type)

        return pa.RecordBatch.from_arrays([column(f) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        partition = context.partitionId() if context else 0
        ask = lambda provider, slice_: annotate_rows(spec, provider, slice_[1])
        if len(spec.provider.base_urls) > 1:
            makers = [lambda make=make: warmed(make()) for make in spec.provider.makers(partition)]
            share = -(-in_flight(spec.queue_size, len(makers)) // max(1, spec.pool_tasks))
            # Makers begin with the task's own server where tasks choose; places are numbered alike in all tasks.
            leases = Leases(spec.leases, partition) if spec.leases is not None else None
            if leases is not None:
                makers = [lambda make=make: warmed(make()) for make in spec.provider.makers(0)]
            with ServerPool(makers, leases=leases) as pool:
                yield from (merged(part, rows, results) for (part, rows), results in pool.run(slices(batches), ask, share))
            return
        provider = None
        try:
            if spec.together:
                # Every engine is up and warm before the first batch; a task without rows has one to wait for as well.
                provider = warmed(spec.provider.build(partition))
                BarrierTaskContext.get().barrier()
            for part, rows in slices(batches):
                if provider is None:
                    provider = warmed(spec.provider.build(partition))
                yield merged(part, rows, annotate_rows(spec, provider, rows))
        finally:
            if provider is not None and not spec.provider.shared:
                provider.close()

    return run


def annotate(df: DataFrame, spec: AnnotateSpec) -> DataFrame:
    """Answers for prepared rows. The result is lazy: write it once, as each evaluation asks the model again."""
    messages = f"{spec.task_prefix}messages"
    if messages not in df.columns:
        raise ValueError(f"column {messages!r} is missing; prepare the table first")
    schema = spec.output_schema_of(df)
    callables = [c for c in (spec.validate, spec.postprocess) if c is not None]
    for c in callables:
        inspect.signature(c)  # not callable: fails here, not in a task
    needed = df.columns if callables else [c for c in df.columns if c in schema.names or c == messages]
    sent = df.select(*[F.to_json(f"`{c}`").alias(c) if isinstance(df.schema[c].dataType, T.VariantType) else F.col(f"`{c}`") for c in needed])
    placed = {"barrier": spec.together, "profile": engine_profile(spec.task_resources)} if spec.together or spec.task_resources else {}
    return read_variants(sent.mapInArrow(worker(spec, on_wire(schema)), on_wire(schema), **placed), schema)


def engine_profile(resources: dict[str, float] | None) -> ResourceProfile | None:
    """Stage-level profile: so much of each resource for a task, and at least a whole one on its executor."""
    if not resources:
        return None
    tasks, executors = TaskResourceRequests(), ExecutorResourceRequests()
    for name, amount in sorted(resources.items()):
        if name == "cpus":
            tasks.cpus(int(amount))
        else:
            tasks.resource(name, amount)
            executors.resource(name, max(1, math.ceil(amount)))
    builder = ResourceProfileBuilder().require(tasks)
    if set(resources) - {"cpus"}:
        builder = builder.require(executors)
    return builder.build


def on_wire(schema: T.StructType) -> T.StructType:
    """The schema that workers hand on: variants are JSON text there."""
    return T.StructType([T.StructField(f.name, T.StringType()) if isinstance(f.dataType, T.VariantType) else f for f in schema.fields])


def read_variants(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[as_variant(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.VariantType) else F.col(f"`{f.name}`") for f in schema.fields])


def batch_number(rank: Column, batch_size: int) -> Column:
    return F.floor(rank / F.lit(batch_size))


def batched(df: DataFrame, rank: str, batch_size: int, order: str, partitions: int | None = None) -> DataFrame:
    """Deal rows by batches of neighbouring ranks, so that long prompts do not meet in one task."""
    numbered = df.withColumn("__batch", batch_number(F.col(rank), batch_size))
    dealt = numbered.repartition(partitions, "__batch") if partitions else numbered.repartition("__batch")
    return dealt.sortWithinPartitions("__batch", order).drop("__batch")


def in_flight(queue_size: int | None, clients: int) -> int:
    """Batches in flight over a pool: 4 a client by default, never fewer than clients."""
    if queue_size is None:
        return 4 * clients
    if queue_size < 1:
        raise ValueError("queue_size must be 1 or more")
    if queue_size < clients:
        log.warning("queue_size %d is raised to the number of clients, %d", queue_size, clients)
    return max(queue_size, clients)
