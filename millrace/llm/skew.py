"""Joins with groups whose size is known: large groups are sliced by their size, so none is one task's work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import shuffle_partitions

#: Rows of a group in one slice, at least.
LEAST_ROWS = 64


def slice_rows(total: int, partitions: int) -> int:
    """Rows of a slice: an even share of all rows, so at most ``2 * partitions`` slices are full."""
    return max(LEAST_ROWS, -(-total // max(1, partitions)))


def spread_join(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, by: Sequence[str | Column], null_safe: bool = False) -> DataFrame:
    """``rows`` joined with ``groups`` on ``keys``; ``groups`` has one row a key and the key's number of rows in ``size``.

    Groups above an even share of all rows are cut into slices by their size: the rows by
    a hash of ``by``, and the group's row is repeated once a slice. The list of large groups
    that is broadcast has at most as many entries as there are shuffle partitions, as each
    holds a whole share. ``groups`` is read three times, so it should be staged.
    """
    keys = list(keys)
    sums = groups.agg(F.sum(size).alias("total"), F.max(size).alias("most")).first()
    share = slice_rows(sums.total or 0, shuffle_partitions(rows.sparkSession))
    slices = F.ceil(F.col(size) / F.lit(share)).cast("int")
    # Null-safely, a null key is a group of its own; otherwise it joins nothing.
    same = lambda a, b: a.eqNullSafe(b) if null_safe else a == b
    if (sums.most or 0) <= share:  # nothing to slice
        named = groups.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
        return rows.join(named.hint("merge"), [same(rows[k], named[f"__r_{k}"]) for k in keys]).drop(*[f"__r_{k}" for k in keys])
    large = groups.filter(F.col(size) > share).select(*[F.col(k).alias(f"__l_{k}") for k in keys], slices.alias("__slices"))
    at = [same(rows[k], large[f"__l_{k}"]) for k in keys]
    marked = rows.join(F.broadcast(large), at, "left").withColumn("__slice", F.coalesce(F.pmod(F.xxhash64(*by), F.col("__slices")).cast("int"), F.lit(0)))
    marked = marked.drop("__slices", *[f"__l_{k}" for k in keys])
    dealt = groups.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(slices, F.lit(1)) - 1))).select(*[F.col(k).alias(f"__r_{k}") for k in keys], "__part", *[c for c in groups.columns if c not in keys])
    on = [same(marked[k], dealt[f"__r_{k}"]) for k in keys]
    return marked.join(dealt.hint("merge"), [*on, marked["__slice"] == dealt["__part"]]).drop("__slice", "__part", *[f"__r_{k}" for k in keys])
