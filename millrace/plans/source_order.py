"""Numbers of rows in the order of their source, without sorting or shuffling them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Plan nodes that keep rows where they are, and those that hold or read them.
_NARROW = {"Project", "Filter", "SubqueryAlias", "View"}
_FILES, _MEMORY = {"LogicalRelation"}, {"LocalRelation", "LogicalRDD", "Range"}

#: Names of files that Spark writes: the number of the task and, where there is one, that of the task's file.
_WRITTEN = re.compile(r"((?:.*/)?part-)([0-9]+)(?:(-[^/.]*[-.]c)([0-9]+))?([^/]*)")


def by_path(path: str) -> tuple[str, str]:
    """Key that orders files by path, and those that Spark wrote by their numbers, which outgrow the five and three digits of the names."""
    if (found := _WRITTEN.fullmatch(path)) is None:
        return path, path
    start, task, job, file, ending = (g or "" for g in found.groups())
    return f"{start}{task:0>20}{job}{file:0>20}{ending}", path


def _nodes(plan) -> list[str]:
    names, todo = [], [plan]
    while todo:
        node = todo.pop()
        names.append(node.getClass().getSimpleName())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return names


def in_source_order(df: DataFrame, name: str = "idx") -> DataFrame | None:
    """0, 1, 2... in order of files (``by_path``) and of rows within them; in order of partitions for a table in memory.

    Rows are counted once for each piece of a file that a task reads, and a row's number is
    the count of all earlier pieces and its place in its own. The counts are one row a
    piece, as many as the driver plans anyway; they reach the rows by a join that Spark broadcasts or
    merges by their size. None where the plan joins, groups or sorts, as there is no
    source order then.
    """
    nodes = set(_nodes(df._jdf.queryExecution().analyzed()))
    leaves = nodes - _NARROW
    if len(leaves) != 1 or not leaves <= _FILES | _MEMORY:
        return None
    spark = df.sparkSession
    if leaves <= _FILES:
        keys = {"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start")}
    else:
        keys = {"__file": F.lit(""), "__block": F.spark_partition_id().cast("long")}
    placed = df.select("*", *[c.alias(k) for k, c in keys.items()], F.monotonically_increasing_id().alias("__at"))
    pieces = placed.groupBy("__file", "__block").agg(F.count("*").alias("n"), F.min("__at").alias("first")).collect()
    starts, total = [], 0
    for p in sorted(pieces, key=lambda p: (by_path(p["__file"]), p["__block"])):
        starts.append((p["__file"], p["__block"], total - p["first"]))
        total += p.n
    fields = [T.StructField("__file", T.StringType()), T.StructField("__block", T.LongType()), T.StructField("__start", T.LongType())]
    table = spark.createDataFrame(starts, T.StructType(fields))
    return placed.join(table, ["__file", "__block"]).select((F.col("__at") + F.col("__start")).alias(name), *[F.col(f"`{c}`") for c in df.columns])
