from collections import Counter

from pyspark.sql import functions as F

from millrace.llm.skew import slice_rows, spread_join
from millrace.llm.staging import stage


def test_large_groups_are_sliced_and_joined_whole(spark):
    rows = stage(spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("k"), F.col("id").alias("row")), "rows")
    rows = rows.unionByName(spark.createDataFrame([(99, -1)], rows.schema))
    groups = stage(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("row").alias("most")), "groups")
    want = Counter((r.k, r.row) for r in rows.collect())
    joined = spread_join(rows, groups, ["k"], "n", ["row"], null_safe=True)
    assert joined.columns == ["k", "row", "n", "most"]
    assert Counter((r.k, r.row) for r in joined.collect()) == want
    most = {r.k: r.most for r in groups.collect()}
    assert all(r.most == most[r.k] for r in joined.collect())
    assert Counter((r.k, r.row) for r in spread_join(rows, groups, ["k"], "n", ["row"]).collect()) == Counter({k: v for k, v in want.items() if k[0] is not None})
    even = stage(groups.filter("k is not null").withColumn("n", F.lit(1).cast("long")), "even")
    assert spread_join(rows, even, ["k"], "n", ["row"]).count() == sum(v for k, v in want.items() if k[0] is not None)
    assert spread_join(rows.limit(0), stage(groups.limit(0), "none"), ["k"], "n", ["row"]).count() == 0


def test_slices_are_an_even_share():
    assert slice_rows(10, 4) == 64 and slice_rows(100_000, 10) == 10_000 and slice_rows(0, 0) == 64
