"""Order of a source whose tasks wrote more files than the digits of their names tell."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from millrace.plans.source_order import by_path, in_source_order

JOB = "0f3c9c1e-c123-4c57-a1b2-c00000000012"
IN_ORDER = [
    [f"a/part-00007-{JOB}-c{k:03d}.snappy.parquet" for k in (0, 99, 100, 101, 999, 1000, 1001, 9999, 10000)],
    [f"a/part-{t:05d}-{JOB}-c{k:03d}.json" for t in (0, 99999, 100000) for k in (0, 1000)],
    [f"/a/lang=x/part-00000-{JOB}.c{k:03d}.gz.parquet" for k in (998, 999, 1000, 1010)],
    [f"s3a://b/x/part-00000-{JOB}_00003.c{k:03d}.parquet" for k in (999, 1000)],
    [f"a/part-{t:05d}-{JOB}.parquet" for t in (9, 10, 99999, 100000)],
    [f"a/part-{t:05d}" for t in (9, 99999, 100000)],
    # Folders, and names that are not Spark's, stay in order of their characters.
    [f"{folder}/part-00000-{JOB}-c1000.parquet" for folder in ("a", "b/c1000", "b/c101", "b", "c")],
    ["a/1.json", "a/10.json", "a/9.json", "a/shard-c1000.json", "a/shard-c101.json"],
]


def test_files_in_order_of_their_numbers():
    for names in IN_ORDER:
        mixed = random.Random(3).sample(names, len(names))
        assert sorted(mixed, key=by_path) == names


def test_rows_of_more_than_a_thousand_files_of_a_task(spark, tmp_path):
    """As Spark names them: c999 is followed by c1000, which stands between c100 and c101 by its characters."""
    spark.range(0, 1012, 1, 1).write.option("maxRecordsPerFile", 1).parquet(f"file://{tmp_path}/in")
    assert len(list((tmp_path / "in").glob("*-c1000*.parquet"))) == 1
    found = in_source_order(spark.read.parquet(f"file://{tmp_path}/in"))
    assert found.filter("idx <> id").isEmpty() and found.count() == 1012


def test_tasks_beyond_five_digits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for at, task in enumerate((99998, 99999, 100000)):
        pq.write_table(pa.table({"at": pa.array([at], pa.int64())}), tmp_path / "in" / f"part-{task:05d}-{JOB}-c000.parquet")
    assert sorted(map(tuple, in_source_order(spark.read.parquet(f"file://{tmp_path}/in")).collect())) == [(0, 0), (1, 1), (2, 2)]
