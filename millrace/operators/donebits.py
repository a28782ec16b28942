"""Done rows as bitmaps: one bit an index, built, merged and tested by Spark's own bitmap functions.

A bucket covers 32 768 neighbouring indices. What is shuffled of a set of done rows is a
bitmap for each bucket and task, not a row for each index, and a bucket that is full carries none.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Indices of one bucket (fixed by Spark's functions).
BITS = 32_768


def countable(df: DataFrame, idx: str) -> bool:
    """Whether an index is a whole number, which has a bit."""
    return isinstance(df.schema[idx].dataType, T.IntegralType)


def bitmaps(rows: DataFrame, idx: str, error: str | None = None, scope: Iterable[str] = ()) -> DataFrame:
    """(bucket, done, good, scope columns): the bits of all rows, and of those without an error. Null indices have none."""
    at = F.col(idx).cast("long")
    bit = F.bitmap_bit_position(at)
    good = bit if error is None else F.when(F.col(error).isNull(), bit)
    keyed = rows.filter(at.isNotNull()).select(F.bitmap_bucket_number(at).alias("bucket"), bit.alias("bit"), good.alias("good"), *scope)
    return keyed.groupBy("bucket", *scope).agg(F.bitmap_construct_agg("bit").alias("done"), F.bitmap_construct_agg("good").alias("good"))


def merged(maps: DataFrame, column: str = "done", scope: Iterable[str] = ()) -> DataFrame:
    """One row a bucket: its bits over all given maps; null bits where every index is set."""
    one = maps.groupBy("bucket", *scope).agg(F.bitmap_or_agg(column).alias("bits"))
    return one.withColumn("bits", F.when(F.bitmap_count("bits") < BITS, F.col("bits")))


def has_bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def skip_set(rows: DataFrame, maps: DataFrame, idx: str) -> DataFrame:
    """Rows whose bit is not set in merged ``maps`` (bucket, bits). Spark broadcasts the maps or merges, by their size."""
    at = F.col(idx).cast("long")
    found = rows.withColumn("__bucket", F.bitmap_bucket_number(at)).join(maps.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"), F.lit(True).alias("__any")), "__bucket", "left")
    unset = F.col("__any").isNull() | (F.col("__bits").isNotNull() & ~has_bit(F.col("__bits"), F.bitmap_bit_position(at)))
    return found.filter(unset).select(*rows.columns)


def n_set(maps: DataFrame) -> int:
    """Indices that are set in merged maps."""
    return maps.agg(F.sum(F.coalesce(F.bitmap_count("bits"), F.lit(BITS)))).first()[0] or 0
