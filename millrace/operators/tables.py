"""Relational operators between annotation steps: resume, dedup, filters, names, statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.tables import first_of


def done_rows(progress: DataFrame, idx: str = "idx", retry_errors: str | None = None, **scope: str | None) -> DataFrame:
    """Indices that are done. A scope such as ``dataset_split="train"`` holds for rows that name theirs.

    ``retry_errors`` names an error column whose rows count as not done.
    """
    if idx not in progress.columns:
        raise ValueError(f"progress has no column {idx!r}")
    for column, value in scope.items():
        if value is not None and column in progress.columns:
            progress = progress.filter(F.col(column).isNull() | (F.col(column) == value))
    if retry_errors:
        progress = progress.filter(F.col(retry_errors).isNull())
    return progress.select(idx).distinct()


def skip_done(prepared: DataFrame, done: DataFrame, idx: str = "idx") -> DataFrame:
    """Prepared rows that are not done."""
    return prepared.join(done.select(idx), idx, "left_anti")


def keep_first(df: DataFrame, keys: Iterable[str | Column], order: Iterable[str | Column]) -> DataFrame:
    return first_of(df, list(keys), list(order))


def dedup_by_hash(df: DataFrame, column: str, order: Iterable[str | Column]) -> DataFrame:
    """First row of each distinct value, compared by SHA-256; null is a value."""
    digest = F.sha2(F.coalesce(F.concat(F.lit("v"), F.col(column).cast("string")), F.lit("n")), 256)
    return first_of(df.withColumn("__digest", digest), ["__digest"], list(order)).drop("__digest")


def filter_invalid(df: DataFrame, prefix: str = "") -> DataFrame:
    """Rows whose required fields were all there; a null verdict counts as no."""
    column = f"{prefix}valid_fields"
    if column not in df.columns:
        raise ValueError(f"column {column!r} is missing; the step needs an output schema")
    return df.filter(F.coalesce(F.col(column), F.lit(False)))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns; missing ones and names that are taken are errors."""
    missing = [c for c in names if c not in df.columns]
    after = [names.get(c, c) for c in df.columns]
    twice = sorted({c for c in after if after.count(c) > 1})
    if missing or twice:
        raise ValueError(f"cannot rename: missing {missing}, named twice {twice}")
    return df.toDF(*after)


def drop(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop columns; missing ones are an error."""
    columns = list(columns)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"cannot drop missing columns {missing}")
    return df.drop(*columns)


def metadata_counts(df: DataFrame, prefix: str = "") -> DataFrame:
    """(what, value, n) of finish reasons, verdicts and error types, in one pass over the rows."""
    cases = []
    for name in ("finish_reason", "error_type"):
        if f"{prefix}{name}" in df.columns:
            cases.append((name, F.coalesce(F.col(f"{prefix}{name}").cast("string"), F.lit("none"))))
    if f"{prefix}valid_fields" in df.columns:
        verdict = F.col(f"{prefix}valid_fields")
        cases.append(("valid_fields", F.when(verdict.isNull(), "none").when(verdict, "valid").otherwise("invalid")))
    pairs = F.array(*[F.struct(F.lit(n).alias("what"), v.alias("value")) for n, v in cases])
    return df.select(F.explode(pairs).alias("x")).groupBy("x.what", "x.value").agg(F.count("*").alias("n"))


#: Percentiles that ``token_stats`` reports.
PERCENTILES = (95.0, 99.0, 99.5, 99.9, 99.95, 99.99)


def token_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean, least, most and high percentiles (interpolated, exact) of a count."""
    c = F.col(column)
    at = F.percentile(c, F.array(*[F.lit(p / 100) for p in PERCENTILES]))
    row = df.agg(F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), at.alias("at"))
    return row.select("mean", "min", "max", *[F.col("at")[k].alias(f"p{str(p).removesuffix('.0').replace('.', '_')}") for k, p in enumerate(PERCENTILES)])


def within_token_limit(df: DataFrame, column: str, limit: int) -> DataFrame:
    return df.filter(F.col(column) <= limit).drop(column)


def batch_alarms(df: DataFrame, verdict: str, idx: str, batch_size: int) -> DataFrame:
    """(batch, rows) of batches without a single valid row."""
    groups = df.groupBy(F.floor(F.col(idx) / F.lit(batch_size)).alias("batch"))
    return groups.agg(F.count("*").alias("rows"), F.max(F.coalesce(F.col(verdict), F.lit(False))).alias("any")).filter(~F.col("any")).drop("any")
