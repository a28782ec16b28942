import pytest
from pyspark.sql import functions as F

from millrace.providers import ProviderSpec
from millrace.streaming.done_state import annotate_once, answered_counts, unseen
from tests.test_annotate import CountingProvider, prepared, spec


def feed(spark, tmp_path, rows):
    rows.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def test_each_index_is_asked_once_over_restarts(spark, tmp_path):
    """Rows that come again, in one micro-batch, in the next, and after two restarts, are not asked again."""
    log = str(tmp_path / "log")
    counting = spec(ProviderSpec(CountingProvider, init={"log": log}))
    run = lambda source: annotate_once(source, counting, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    rows = prepared(spark, 20)
    feed(spark, tmp_path, rows.filter("idx < 8").unionAll(rows.filter("idx in (1, 2)")))
    run(feed(spark, tmp_path, rows.filter("idx between 4 and 11")))
    run(feed(spark, tmp_path, rows.filter("idx < 15")))
    run(feed(spark, tmp_path, rows))
    assert sorted(open(log).read().split()) == sorted(w for k in range(20) for w in ("document", str(k)))
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted((r.idx, r.response) for r in out.collect()) == [(k, f"document {k}") for k in range(20)]


def test_a_micro_batch_that_failed_is_asked_again(spark, tmp_path):
    log, rows = str(tmp_path / "log"), prepared(spark, 6)
    source = feed(spark, tmp_path, rows)
    with pytest.raises(Exception, match="gone"):
        annotate_once(source, spec(ProviderSpec(Gone, init={"log": log})), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    annotate_once(source, spec(ProviderSpec(CountingProvider, init={"log": log})), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 6


class Gone(CountingProvider):
    def generate(self, messages, options, **extra):
        raise RuntimeError("gone")


def test_a_watermark_bounds_the_state(spark, tmp_path):
    rows = prepared(spark, 5).withColumn("at", F.timestamp_seconds(F.col("idx") * 10 + 1000))
    source = unseen(feed(spark, tmp_path, rows.unionAll(rows)), "idx", "1 minute", "at")
    source.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 5


def test_counts_take_each_index_once(spark, tmp_path):
    rows = prepared(spark, 9)
    feed(spark, tmp_path, rows)
    answered_counts(feed(spark, tmp_path, rows), spec(), "text", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    last = spark.read.parquet(f"file://{tmp_path}/out/batch=1")
    assert last.count() == 9 and last.filter("n <> 1").isEmpty()
