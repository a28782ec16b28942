"""Staged tables: cut lineage by writing to the cluster's shared folder.

Every multi-pass operator writes what it reuses as Parquet below
``spark.checkpoint.dir``. The files outlive a lost executor, and the shuffle
files of the pass that made them are released as soon as it ends. A result is
lazy and reads staged tables, so they stay until it is written; inside
``temporary`` they are deleted at the end, but for what is kept.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Paths of the tables staged inside each open ``temporary``.
_OPEN: list[list[str]] = []


class Temporary:
    def __init__(self, paths: list[str]):
        self.paths = paths

    def keep(self, df: DataFrame) -> DataFrame:
        """Keep a staged table beyond the block."""
        self.paths.remove(df._staged_at)
        return df


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Delete what is staged inside the block when it ends. Write results inside it, or keep them."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield Temporary(paths)
    finally:
        _OPEN.pop()
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return it as read from the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if _OPEN:
        _OPEN[-1].append(path)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        _delete(df.sparkSession, df._staged_at)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
