"""Batches that reach the model are whole, however Arrow cuts a task's rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators.annotate import AnnotateSpec, annotate, resized
from millrace.plans.prepare import PrepareSpec, prepare
from millrace.providers import ProviderSpec
from millrace.queries import QUERIES, SQL, BatchLengthProvider
from tests.conftest import SF

duckdb = pytest.importorskip("duckdb")


@pytest.fixture
def small_arrow_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("sizes", [[10, 10, 3], [1] * 23, [23], [0, 20, 0, 3, 0], [8, 8, 7], []])
def test_rows_keep_their_order_in_batches_of_one_size(sizes):
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    given = [pa.RecordBatch.from_pydict({"x": pa.array(range(end - n, end), pa.int64())}) for n, end in zip(sizes, ends)]
    found = [b.column(0).to_pylist() for b in resized(iter(given), 8)]
    assert sum(found, []) == list(range(sum(sizes))) and [len(b) for b in found] == ([8, 8, 7] if sizes else [])


def test_the_model_gets_whole_batches(spark, small_arrow_batches):
    rows = prepare(spark.range(0, 150, 1, 1).withColumnRenamed("id", "idx"), PrepareSpec("{idx}"))
    found = annotate(rows, AnnotateSpec(ProviderSpec(BatchLengthProvider), batch_size=64))
    sizes = found.groupBy(F.split("response", " ")[0].cast("int").alias("n")).count().collect()
    assert sorted(map(tuple, sizes)) == [(22, 22), (64, 128)]


def test_batches_sorted_by_length_match_their_sql(spark, small_arrow_batches):
    found = QUERIES["length_sorted_batches"](spark, SF).select("batch", "n", "longest", "shortest").collect()
    told = duckdb.sql(SQL["length_sorted_batches"].replace("FROM documents", f"FROM '{SF}/documents.parquet'")).select("batch, n, longest, shortest").fetchall()
    assert sorted(map(tuple, found)) == sorted(told)
