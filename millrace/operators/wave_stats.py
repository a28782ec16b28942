"""Statistics of a run that merge: counts and a quantile sketch of each wave, written when it ends.

Totals over a run are those of its waves added up and their sketches merged; the rows of
earlier waves are not read again. Percentiles of a merged sketch are off by about
``RANK_ERROR`` of all ranks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.tables import PERCENTILES, metadata_counts

#: Size of a sketch, and the share of ranks that a percentile may be off by (of KLL sketches of this size, with 99 % confidence).
SKETCH_SIZE, RANK_ERROR = 800, 0.0035


def wave_stats(rows: DataFrame, prefix: str = "", tokens: str = "num_tokens") -> DataFrame:
    """(what, value, n, low, high, total, sketch): verdict counts, one row each, and a row of token numbers, in one pass over narrow columns."""
    empty = {"low": "long", "high": "long", "total": "long", "sketch": "binary"}
    counts = metadata_counts(rows, prefix).withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
    n = F.col(f"{prefix}{tokens}").cast("long")
    numbers = rows.agg(F.count(n).alias("n"), F.min(n).alias("low"), F.max(n).alias("high"), F.sum(n).alias("total"), F.kll_sketch_agg_bigint(n, SKETCH_SIZE).alias("sketch"))
    told = numbers.select(F.lit("tokens").alias("what"), F.lit("all").alias("value"), "n", "low", "high", "total", "sketch")
    every = rows.agg(F.count("*").alias("n")).select(F.lit("rows").alias("what"), F.lit("all").alias("value"), "n", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    return counts.select("what", "value", "n", *empty).unionByName(told).unionByName(every)


def merged_stats(stats: DataFrame) -> DataFrame:
    """The same rows over all given waves."""
    merged = F.kll_merge_agg_bigint("sketch", SKETCH_SIZE)
    plain = stats.filter("what <> 'tokens'").groupBy("what", "value").agg(F.sum("n").alias("n"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("binary").alias("sketch"))
    tokens = stats.filter("what = 'tokens' and n > 0").groupBy("what", "value").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), merged.alias("sketch"))
    return plain.unionByName(tokens)


def token_percentiles(merged: DataFrame) -> DataFrame:
    """mean, min, max and high percentiles of the tokens of merged statistics, as ``token_stats`` names them."""
    at = [F.kll_sketch_get_quantile_bigint("sketch", F.lit(p / 100)).alias(f"p{str(p).removesuffix('.0').replace('.', '_')}") for p in PERCENTILES]
    return merged.filter("what = 'tokens'").select((F.col("total") / F.col("n")).alias("mean"), F.col("low").alias("min"), F.col("high").alias("max"), *at)


def counted(merged: DataFrame) -> tuple[int, dict[str, dict[str, int]]]:
    """Rows, and the counts by what they count, of merged statistics."""
    counts: dict[str, dict[str, int]] = {}
    rows = 0
    for r in merged.filter("what <> 'tokens'").select("what", "value", "n").collect():
        if r.what == "rows":
            rows = r.n
        else:
            counts.setdefault(r.what, {})[r.value] = r.n
    return rows, counts


def read_stats(spark: SparkSession, folders: list[str]) -> DataFrame | None:
    return merged_stats(spark.read.parquet(*folders)) if folders else None
