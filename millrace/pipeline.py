"""Chained annotation steps with a snapshot of each."""

from __future__ import annotations

import hashlib
import json
import logging
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from millrace.config import PipelineConfig
from millrace.operators.annotate import AnnotateSpec
from millrace.operators.tables import drop, filter_invalid, rename
from millrace.plans.annotator import annotate_dataset, generate_dataset
from millrace.providers.http import wait_for_servers
from millrace.plans.prepare import source_state
from millrace.sources.tables import delete, exists, load_dataset, read_text, write_text

log = logging.getLogger("millrace.pipeline")


def selection(config: PipelineConfig, names: list[str] | None) -> list[int]:
    """Numbers of the selected steps, which must follow each other."""
    every = [s.name for s in config.steps]
    if not names:
        return list(range(len(every)))
    if unknown := [n for n in names if n not in every]:
        raise ValueError(f"unknown steps {unknown}; there are {every}")
    picked = sorted(every.index(n) for n in set(names))
    if picked != list(range(picked[0], picked[-1] + 1)):
        raise ValueError(f"the selected steps leave a hole: {[every[k] for k in picked]}")
    return picked


#: What of a step's configuration does not change its table.
_ASIDE = ("backup", "force_data_preparation", "max_samples_per_output_file", "upload_every_n_samples")


def step_mark(config: PipelineConfig, k: int, root: Path) -> str:
    """Hash of what a step does: prompts, schema, model and options, filters and names; not of servers and secrets."""
    step, spec = config.steps[k], step_spec(config, k, root)
    told = {n: v for n, v in asdict(step).items() if n not in _ASIDE}
    prompts = step.all_prompts(root) if step.type == "generate" else None
    return _hash([told, step.template(root), step.system(root), prompts, spec.mark(), spec.task_prefix, config.idx_column])


def _hash(what: object) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()


def run_pipeline(spark: SparkSession, config: PipelineConfig, steps: list[str] | None = None, **run_options) -> DataFrame:
    """Run the selected steps; finished ones are read back. The last step's table is written to ``final``.

    Beside each step's output stand the hash of what the step does and that of all it was
    made from. An output of another step or of another source is made anew; earlier steps that are
    not selected must have been made by the same configuration.
    """
    picked, root = selection(config, steps), Path(config.config_dir)
    note = lambda k: f"{config.step_dir(k)}/output.fingerprint"
    there = lambda k: exists(spark, f"{config.step_dir(k)}/output/_SUCCESS") and exists(spark, note(k))
    if config.overwrite:
        for k in picked:
            delete(spark, config.step_dir(k))
    if missing := [config.steps[k].name for k in range(picked[0]) if not there(k)]:
        raise RuntimeError(f"earlier steps are not finished: {missing}")
    if other := [config.steps[k].name for k in range(picked[0]) if json.loads(read_text(spark, note(k)))["step"] != step_mark(config, k, root)]:
        raise RuntimeError(f"earlier steps were made by another configuration: {other}")
    write_text(spark, f"{config.output_dir}/pipeline.json", json.dumps(asdict(config), indent=2, default=str))
    if picked[0]:
        data, came_from = spark.read.parquet(f"{config.step_dir(picked[0] - 1)}/output"), json.loads(read_text(spark, note(picked[0] - 1)))["all"]
    else:
        data = None if config.steps[0].type == "generate" else source_of(spark, config, root)
        came_from = _hash([asdict(config.dataset), source_state(data)]) if data is not None else ""
    for k in picked:
        out, step = f"{config.step_dir(k)}/output", step_mark(config, k, root)
        made = json.dumps({"step": step, "all": (came_from := _hash([step, came_from]))})
        if not there(k) or read_text(spark, note(k)) != made:
            if exists(spark, f"{out}/_SUCCESS"):
                log.warning("step %s: its output was made from something else; it is made anew", config.steps[k].name)
            delete(spark, note(k))
            run_step(spark, config, k, data, root, **run_options).write.mode("overwrite").parquet(out)
            write_text(spark, note(k), made)
        data = spark.read.parquet(out)
    if picked[-1] == len(config.steps) - 1:
        for place in filter(None, [f"{config.output_dir}/final", config.backup]):
            data.write.mode("overwrite").parquet(place)
    return data


def source_of(spark: SparkSession, config: PipelineConfig, root: Path) -> DataFrame:
    """The table that the first step reads."""
    source = config.dataset
    folder = None if source.path is None else source.path if "://" in source.path else str(root / source.path)
    return load_dataset(spark, folder or source.data_dir or source.name, split=source.split, fmt=source.name if source.data_dir else "parquet", config=source.config)


def step_spec(config: PipelineConfig, k: int, root: Path) -> AnnotateSpec:
    step, client = config.steps[k], config.step_client(config.steps[k])
    return AnnotateSpec(client.provider_spec(root), step.schema(root), step.prefix, config.idx_column, True, client.batch_size, step.num_retries_invalid, verbose=config.verbose, queue_size=client.queue_size)


def run_step(spark: SparkSession, config: PipelineConfig, k: int, data: DataFrame | None, root: Path, **run_options) -> DataFrame:
    """One step over the previous one's table; then filter, drop messages, rename, drop columns."""
    step, client, spec = config.steps[k], config.step_client(config.steps[k]), step_spec(config, k, root)
    if spec.provider.base_urls and client.wait_for_servers:
        wait_for_servers(spec.provider.base_urls, client.wait_for_servers)
    where, prepare = config.step_dir(k), {"sort_by_length": step.sort_by_length, "num_proc": client.num_proc}
    options = {"system": step.system(root), "force_data_preparation": step.force_data_preparation, "backup": step.backup, "rows_per_file": step.max_samples_per_output_file, "backup_every": step.upload_every_n_samples or 0, **run_options}
    if step.type == "generate":
        found = generate_dataset(spark, step.all_prompts(root), where, spec, prompt_template=step.template(root), prepare_options=prepare, **options)
    else:
        if k == 0:
            source = config.dataset
            options |= {"dataset_split": source.split, "dataset_config": source.config}
            prepare |= {"shuffle_seed": source.shuffle_seed, "max_samples": source.max_num_samples}
        found = annotate_dataset(data, where, spec, step.template(root), prepare_options=prepare, **options)
    if run_options.get("max_waves") is not None and not exists(spark, f"{where}/{step.prefix}final.fingerprint"):
        raise RuntimeError(f"step {step.name!r} is not finished")
    before = found.count()
    if step.filter_invalid:
        found = filter_invalid(found, step.prefix)
        if not (left := found.count()):
            raise ValueError(f"step {step.name!r}: none of {before} rows is valid")
        log.info("step %s: %d of %d rows are valid", step.name, left, before)
    if not step.keep_messages:
        found = found.drop(f"{step.prefix}messages")
    return drop(rename(found, step.rename), step.drop_columns)


def serve_args(config: PipelineConfig, name: str) -> list[str]:
    """Flags to serve a step's engine with."""
    step = config.steps[selection(config, [name])[0]]
    client = config.step_client(step)
    if not client.provider.startswith("vllm"):
        raise ValueError(f"step {name!r} has no engine to serve")
    return client.engine.serve_args()


def with_hosts(config: PipelineConfig, hosts_file: str, steps: list[str] | None = None) -> dict[str, dict]:
    """Client overrides that point the selected served steps to a file of hosts; they must agree on the model."""
    served = [config.steps[k] for k in selection(config, steps) if config.step_client(config.steps[k]).provider == "vllm_online"]
    models = {config.step_client(s).model for s in served}
    if not served or len(models) > 1:
        raise ValueError("a file of hosts needs served steps of one model")
    return {s.name: {"hosts_file": str(Path(hosts_file).absolute())} for s in served}
