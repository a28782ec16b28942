"""Reading and writing tables and small files on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _at(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def list_files(spark: SparkSession, path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of the files right below a folder, by name."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return []
    found = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(where) if s.isFile()]
    return sorted(f for f in found if f[0].endswith(suffix))


def has_files(spark: SparkSession, path: str, suffix: str = "") -> bool:
    """Whether a folder has a file of that ending right below it; the listing stops at the first."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return False
    found = fs.listStatusIterator(where)
    while found.hasNext():
        status = found.next()
        if status.isFile() and status.getPath().getName().endswith(suffix):
            return True
    return False


def committed(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Folders ``<prefix>*`` below ``path`` whose job was committed, by name; found by one listing."""
    fs, where = _at(spark, f"{path}/{prefix}*/_SUCCESS")
    return sorted(s.getPath().getParent().toString() for s in fs.globStatus(where) or ())


def load_dataset(spark: SparkSession, name: str | None = None, data: DataFrame | None = None, split: str | None = None, fmt: str = "parquet", config: str | None = None, **options: str) -> DataFrame:
    """A named table, a folder of files, or a given DataFrame: exactly one source.

    Splits are folders ``split=<name>`` and configurations folders ``config=<name>``;
    without one named, the only one is taken.
    """
    if (name is None) == (data is None):
        raise ValueError("give exactly one of a name and a DataFrame")
    if data is None:
        data = spark.table(name) if "/" not in name and spark.catalog.tableExists(name) else spark.read.format(fmt).options(**options).load(name)
    return with_split(with_split(data, config, "config"), split)


def with_split(df: DataFrame, split: str | None, column: str = "split") -> DataFrame:
    """Rows of a split, or of a configuration, if the table has a column of that name."""
    if column not in df.columns:
        if split is not None:
            raise ValueError(f"the table has no {column} {split!r}")
        return df
    if split is None:
        names = [r[0] for r in df.select(column).distinct().limit(2).collect()]
        if len(names) > 1:
            raise ValueError(f"several values of {column}; name one, such as {names[0]!r}")
    elif df.filter(F.col(column) == split).isEmpty():
        raise ValueError(f"the table has no {column} {split!r}")
    return (df.filter(F.col(column) == split) if split is not None else df).drop(column)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None, dedup_on: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines and, apart, the lines that are none.

    ``columns`` projects; ``dedup_on`` keeps the first row, in order of files and lines, of
    each value of a column.
    """
    full = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line")).filter(F.trim("value") != "")
    parsed = lines.withColumn("j", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", "allowSingleQuotes": "false"}))
    good, bad = parsed.filter("j.__bad is null and j is not null"), parsed.filter("j.__bad is not null or j is null").select("__file", "value")
    rows = good.select("__file", "__block", "__line", *[F.col("j")[f.name].alias(f.name) for f in schema.fields])
    if dedup_on:
        rows = first_of(rows, [F.sha2(F.col(dedup_on).cast("string"), 256)], [F.col("__file"), F.col("__block"), F.col("__line")])
    return rows.select(*(columns or [f.name for f in schema.fields])), bad


def first_of(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """One prompt a line, without blank lines."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("prompt"))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def remove_empty_files(spark: SparkSession, path: str, suffix: str = ".jsonl") -> list[str]:
    """Delete files without content right below a folder; their names, sorted."""
    empty = [f for f, n in list_files(spark, path, suffix) if n == 0]
    for f in empty:
        delete(spark, f)
    return empty


def rotated_name(stem: str, written: int, most: int, suffix: str = ".jsonl") -> str:
    """File for the next row after ``written`` rows, ``most`` rows a file; 0 is one file for all."""
    return f"{stem}_{written // most}{suffix}" if most > 0 else f"{stem}{suffix}"


def write_jsonl(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """JSON lines, so many rows a file at most."""
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).option("ignoreNullFields", "false").json(path)
