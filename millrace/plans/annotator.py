"""Entry points: prepare, annotate, generate."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.annotate import AnnotateSpec
from millrace.operators.progress import ROWS_PER_FILE, Progress, import_jsonl, run_annotation, to_do, write_final, write_metadata
from millrace.plans.prepare import LENGTH_KEY, PrepareSpec, generated, prepare_data
from millrace.plans.template import PromptTemplate
from millrace.sources.tables import delete, exists, read_text, write_text

log = logging.getLogger("millrace.annotator")


def annotate_dataset(
    df: DataFrame,
    output_dir: str,
    spec: AnnotateSpec,
    prompt_template: str | None = None,
    full_prompt_template: str | None = None,
    system: str | None = None,
    preprocess: Callable[[DataFrame], DataFrame] | None = None,
    backup: str | None = None,
    force_data_preparation: bool = False,
    keep_idx_column: bool = True,
    overwrite: bool = False,
    prepare_options: dict[str, Any] | None = None,
    version: str | None = None,
    import_from: str | None = None,
    dataset_split: str | None = None,
    dataset_config: str | None = None,
    rows_per_file: int = ROWS_PER_FILE,
    backup_every: int = 0,
    **run_options: Any,
) -> DataFrame:
    """Prepare, annotate what is missing, and write ``<output_dir>/final`` with its metadata.

    Prepared rows, progress and result belong to what they were made from: template,
    options, hooks, split, output schema, model and its options, and the source's files (or
    ``version``); servers and secrets do not count. A ``final`` made from the same is returned
    as it is, and progress of the same is resumed; anything else is left aside and made anew.
    A run that ``max_waves`` ends early returns what it has and writes no ``final``; with
    ``retry_errors`` the rows that ended in an error are asked again and a ``final`` is made anew. ``overwrite`` discards progress and result and
    keeps the prepared rows, unless ``force_data_preparation`` is set as well. JSON lines of
    an older run in ``import_from`` count as progress.
    """
    if prompt_template is not None and full_prompt_template is not None:
        raise ValueError("give one of prompt_template and full_prompt_template")
    template = prompt_template if prompt_template is not None else full_prompt_template
    if template is None:
        raise TypeError("a prompt template is needed")
    spark, prefix = df.sparkSession, spec.task_prefix
    plan = PrepareSpec(template, system, prefix, spec.idx_column, keep_columns=spec.keep_columns, **(prepare_options or {}))
    scope = {"dataset_split": dataset_split, "dataset_config": dataset_config}
    mark = plan.fingerprint(df, preprocess, version)
    made = hashlib.sha256(json.dumps([mark, spec.mark(), keep_idx_column, scope], sort_keys=True).encode()).hexdigest()
    final, note = f"{output_dir}/{prefix}final", f"{output_dir}/{prefix}final.fingerprint"
    if overwrite:
        delete(spark, final)
    elif exists(spark, f"{final}/_SUCCESS") and not run_options.get("retry_errors"):
        if exists(spark, note) and read_text(spark, note) == made:
            return spark.read.parquet(final)
        log.warning("%s was made from another source, template, model or schema; it is made anew", final)
        delete(spark, note)
        delete(spark, final)
    copies = {"backup": f"{backup}/{prefix}prepared" if backup else None, "force": force_data_preparation, "mark": mark}
    prepared = prepare_data(df, plan, f"{output_dir}/{prefix}prepared", preprocess, **copies)
    spec = replace(spec, prompt_prefix=PromptTemplate.parse(template).prefix, system=system)
    run = f"{prefix}run/{made[:16]}"
    progress = Progress(spark, f"{output_dir}/{run}", f"{backup}/{run}" if backup else None, rows_per_file, backup_every)
    if import_from is not None and not progress.exists():
        progress.append(import_jsonl(spark, import_from, spec.output_schema_of(prepared.drop(LENGTH_KEY)), spec.idx_column))
    rows = run_annotation(prepared, spec, progress, overwrite=overwrite, **scope, **run_options)
    shown = rows if keep_idx_column else rows.drop(spec.idx_column)
    if run_options.get("max_waves") is not None:
        scoped = {k: v for k, v in scope.items() if v is not None}
        if not to_do(prepared, progress, spec.idx_column, f"{prefix}error", scope=scoped).isEmpty():
            log.warning("%s: the run ends before all rows are done", output_dir)
            delete(spark, note)
            return shown
    delete(spark, note)
    found = write_final(shown, final, f"{backup}/{prefix}final" if backup else None)
    write_text(spark, note, made)
    write_metadata(found, output_dir, prefix, {"template": template, "task_prefix": prefix, "fingerprint": made, **{k: v for k, v in scope.items() if v}})
    return found


def generate_dataset(spark: SparkSession, prompts: str | list[str], output_dir: str, spec: AnnotateSpec, max_num_samples: int | None = None, prompt_template: str = "{prompt}", **options: Any) -> DataFrame:
    """Answers to prompts of one's own: one prompt several times, or each of a list."""
    if "prompt" not in PromptTemplate.parse(prompt_template).names:
        raise ValueError("the template of a generate step must hold {prompt}")
    return annotate_dataset(generated(spark, prompts, max_num_samples), output_dir, spec, prompt_template, **options)
