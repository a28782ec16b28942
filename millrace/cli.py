"""Command line: run a pipeline, or say what its steps need."""

from __future__ import annotations

import argparse
import json
import shlex
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    from millrace.config import load_pipeline
    from millrace.logs import configure
    from millrace.pipeline import run_pipeline, serve_args, with_hosts

    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    p.add_argument("config")
    p.add_argument("--output-dir", help="overrides the configuration's; relative to the current folder")
    p.add_argument("--backup", help="second place for the final table")
    p.add_argument("--log-level")
    p.add_argument("--overwrite", action="store_true", default=None, help="run the selected steps anew")
    p.add_argument("--steps", nargs="+", help="steps to run, which must follow each other")
    p.add_argument("--hosts-file", help="servers of the selected served steps, one a line")
    p.add_argument("--serve-args", metavar="STEP", help="print the flags to serve a step with")
    p.add_argument("--describe-steps", action="store_true", help="print what each step needs, one JSON object a line")
    a = p.parse_args(argv)
    overrides = {"output_dir": str(Path(a.output_dir).absolute()) if a.output_dir and "://" not in a.output_dir else a.output_dir, "backup": a.backup, "log_level": a.log_level, "overwrite": a.overwrite}
    config = load_pipeline(a.config, **overrides)
    if a.hosts_file:
        config = load_pipeline(a.config, with_hosts(config, a.hosts_file, a.steps), **overrides)
    configure(config.log_level)
    if a.describe_steps:
        print(*map(json.dumps, config.describe()), sep="\n")
    elif a.serve_args:
        print(shlex.join(serve_args(config, a.serve_args)))
    else:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("millrace").getOrCreate()
        print(f"{run_pipeline(spark, config, a.steps).count()} rows in {config.output_dir}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
