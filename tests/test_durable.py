"""Durability and belonging of results: commits by task, bits of done rows, leases, source order, fingerprints."""

import collections
import functools
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from millrace.config import DatasetConfig, PipelineConfig
from millrace.functions.identity import code_mark
from millrace.operators import donebits
from millrace.operators import tables as R
from millrace.operators.annotate import AnnotateSpec, annotate
from millrace.operators.progress import Progress, run_annotation
from millrace.pipeline import run_pipeline
from millrace.plans.annotator import annotate_dataset
from millrace.plans.prepare import numbered
from millrace.plans.source_order import in_source_order
from millrace.providers import ProviderSpec, Response, UnavailableError
from millrace.providers.leases import LeaseBroker, Leases
from millrace.providers.pool import ServerPool
from millrace.queries import LastMessageProvider
from millrace.sources import tables as src
from tests.test_annotate import CountingProvider, prepared, spec, texts


class LastToDie(CountingProvider):
    """Raises at one prompt once all the others have been answered and their tasks have ended; answers it when ``cured`` exists."""

    def __init__(self, model="", bad="", others=0, cured="", **kwargs):
        super().__init__(model, **kwargs)
        self.bad, self.others, self.cured = bad, others, cured

    def generate(self, messages, options, **extra):
        if messages[-1]["content"] == self.bad and not os.path.exists(self.cured):
            until = time.time() + 60
            while time.time() < until and sum(1 for _ in open(self.log)) < self.others:
                time.sleep(0.2)
            time.sleep(3)
            raise RuntimeError("the machine is gone")
        return super().generate(messages, options, **extra)


def test_finished_tasks_of_a_failed_job_count(spark, tmp_path):
    """One of eight tasks dies and the job fails; the next run asks for that task's rows alone."""
    log, cured = str(tmp_path / "log"), str(tmp_path / "cured")
    dying = spec(ProviderSpec(LastToDie, init={"log": log, "bad": "document 35", "others": 75, "cured": cured}), batch_size=1)
    rows, progress = prepared(spark, 80), Progress(spark, f"file://{tmp_path}/run")
    with pytest.raises(Exception, match="the machine is gone"):
        run_annotation(rows, dying, progress, partitions=8)
    kept = progress.read()
    assert sorted(r.idx for r in kept.collect()) == [k for k in range(80) if not 30 <= k < 40]
    assert not src.exists(spark, f"{progress.path}/wave=00000000/_SUCCESS")
    (tmp_path / "cured").write_text("")
    os.rename(log, log + "1")
    found = run_annotation(rows, dying, progress, partitions=8)
    assert [r.response for r in found.collect()] == [f"document {k}" for k in range(80)]
    assert sorted(open(log).read().split("\n")[:-1]) == [f"document {k}" for k in range(30, 40)]


def test_rows_are_dealt_to_tasks_of_neighbours(spark, tmp_path):
    progress = Progress(spark, f"file://{tmp_path}/run")
    run_annotation(prepared(spark, 100), spec(), progress, task_rows=10)
    rows = progress.read().withColumn("file", F.input_file_name()).groupBy("file").agg(F.count("*").alias("n"), F.min("idx").alias("low"), F.max("idx").alias("high")).collect()
    assert len(rows) == 10 and all(r.n == 10 and r.high - r.low == 9 for r in rows)


def test_bits_are_the_anti_join(spark, tmp_path):
    idx = [0, 1, 7, 32767, 32768, 32769, 65535, 65536, -1, -32768, -32769, 10**12, 10**12 + 3]
    every = spark.range(70_000).select(F.col("id").alias("idx")).unionByName(spark.createDataFrame([(k,) for k in idx if not 0 <= k < 70_000], "idx long"))
    done = spark.range(32_768, 65_536).select(F.col("id").alias("idx")).unionByName(spark.createDataFrame([(k,) for k in [*idx[:-1], 5, 5]], "idx long"))
    maps = donebits.merged(donebits.bitmaps(done.repartition(5), "idx").unionByName(donebits.bitmaps(done.filter("idx < 9"), "idx"))).cache()
    left = sorted(r.idx for r in donebits.skip_set(every, maps, "idx").collect())
    assert left == sorted(r.idx for r in R.skip_done(every, done.distinct()).collect()) and 10**12 + 3 in left
    assert donebits.n_set(maps) == done.distinct().count()
    full = {r.bucket: r.bits for r in maps.collect()}
    assert [k for k, b in full.items() if b is None] == [2]  # 32769 to 65536


def shuffled_bytes(spark, job):
    store = spark.sparkContext._jsc.sc().statusStore()
    tracker = spark.sparkContext.statusTracker()
    name = f"measured-{time.time()}"
    spark.sparkContext.setJobGroup(name, name)
    job()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


def test_bits_shuffle_little(spark, tmp_path):
    """Of a million done rows, less than a hundredth of what the anti-join shuffles."""
    spark.range(1_000_000).select(F.col("id").alias("idx"), F.lit("x").alias("text")).write.parquet(f"file://{tmp_path}/all")
    spark.range(0, 999_000).select(F.col("id").alias("idx"), F.lit(None).cast("string").alias("error")).write.parquet(f"file://{tmp_path}/done")
    every, done = spark.read.parquet(f"file://{tmp_path}/all"), spark.read.parquet(f"file://{tmp_path}/done")
    counts = {}

    def bits():
        # Written first, as progress does it, so that Spark knows their size.
        donebits.merged(donebits.bitmaps(done, "idx", "error")).write.parquet(f"file://{tmp_path}/bits")
        counts["bits"] = donebits.skip_set(every, spark.read.parquet(f"file://{tmp_path}/bits"), "idx").count()

    def joined():
        counts["join"] = every.join(done.select("idx").distinct().hint("merge"), "idx", "left_anti").count()

    small, large = shuffled_bytes(spark, bits), shuffled_bytes(spark, joined)
    assert counts["bits"] == counts["join"] == 1000 and 0 < small < large / 100


def test_ended_waves_keep_bits_and_broken_ones_are_read(spark, tmp_path):
    progress = Progress(spark, f"file://{tmp_path}/run")
    run_annotation(prepared(spark, 6), spec(), progress)
    assert src.exists(spark, f"{progress.root}/done/wave=00000000/_SUCCESS")
    progress.append(annotate(prepared(spark, 9).filter("idx >= 6"), spec()))  # a wave without bits
    bits = progress.done_bits("idx", "error", False, {})
    assert donebits.n_set(bits) == 9
    assert run_annotation(prepared(spark, 12), spec(), progress).count() == 12


def test_indices_that_are_no_numbers_are_joined(spark, tmp_path):
    rows = prepared(spark, 6).withColumn("idx", F.concat(F.lit("k"), "idx"))
    log = str(tmp_path / "log")
    counting = spec(ProviderSpec(CountingProvider, init={"log": log}))
    progress = Progress(spark, f"file://{tmp_path}/run")
    run_annotation(rows.filter("idx < 'k3'"), counting, progress)
    assert run_annotation(rows, counting, progress, wave_rows=2).count() == 6 and sum(1 for _ in open(log)) == 6


class Failing(LastMessageProvider):
    """Fails on even documents."""

    def generate(self, messages, options, **extra):
        if int(messages[-1]["content"].split()[-1]) % 2 == 0:
            return Response("", None, error="overloaded", error_type="ProviderError")
        return super().generate(messages, options, **extra)


def test_retried_errors_are_replaced(spark, tmp_path):
    progress = Progress(spark, f"file://{tmp_path}/run")
    first = run_annotation(prepared(spark, 8), spec(ProviderSpec(Failing)), progress)
    assert first.filter("error is not null").count() == 4
    again = run_annotation(prepared(spark, 8), spec(), progress, retry_errors=True)
    assert [(r.response, r.error) for r in again.collect()] == [(f"document {k}", None) for k in range(8)]
    # Without asking for it again they stay replaced, and answers without an error are kept.
    later = run_annotation(prepared(spark, 8), spec(ProviderSpec(Failing)), progress, retry_errors=True)
    assert [(r.response, r.error) for r in later.collect()] == [(f"document {k}", None) for k in range(8)]


def test_retry_through_the_entry_point_renews_the_final_table(spark, tmp_path):
    cured = str(tmp_path / "cured")
    flaky = spec(ProviderSpec(Flaky, init={"cured": cured, "on_error": "ignore"}))
    call = functools.partial(annotate_dataset, texts(spark, 6), f"file://{tmp_path}/out", flaky, "{text}", version="1")
    assert call().filter("error is not null").count() == 6
    open(cured, "w").close()
    assert call().filter("error is not null").count() == 6
    assert call(retry_errors=True).filter("error is not null").count() == 0 and call().filter("error is null").count() == 6


class Flaky(LastMessageProvider):
    def __init__(self, model="", cured="", **kwargs):
        super().__init__(model, **kwargs)
        self.cured = cured

    def generate(self, messages, options, **extra):
        if not os.path.exists(self.cured):
            raise UnavailableError("no route")
        return super().generate(messages, options, **extra)


class Other(LastMessageProvider):
    def generate(self, messages, options, **extra):
        return Response("other " + messages[-1]["content"], "stop")


def test_another_model_or_validator_is_another_run(spark, tmp_path):
    where, rows = f"file://{tmp_path}/out", texts(spark, 5)
    run = lambda s: [tuple(r) for r in annotate_dataset(rows, where, s, "{text}", version="1").orderBy("idx").select("response", *(["valid"] if s.validate else [])).collect()]
    assert run(spec())[0] == ("document 0",)
    assert run(spec(ProviderSpec(Other)))[0] == ("other document 0",)
    assert run(spec(ProviderSpec("echo", model="m")))[0] == ("document 0",)
    assert run(spec(validate=lambda r: True))[0] == ("document 0", True)
    assert run(spec(validate=lambda r: False, num_retries_invalid=0))[0] == ("document 0", False)
    marks = [spec(), spec(ProviderSpec("echo", options={"max_completion_tokens": 3})), spec(ProviderSpec("echo", extra={"a": 1})), spec(num_retries_invalid=1), spec(postprocess=lambda r: r), spec(ProviderSpec("echo", base_urls=("a",)))]
    seen = [repr(s.mark()) for s in marks]
    assert len(set(seen[:5])) == 5 and seen[5] == seen[0]


def test_marks_of_code():
    def made(n):
        return lambda r: r + n

    assert code_mark(made(1)) == code_mark(made(1)) != code_mark(made(2))
    assert code_mark(functools.partial(made, 1)) != code_mark(functools.partial(made, 2))
    assert code_mark(lambda r: "a") != code_mark(lambda r: "b")
    assert code_mark(Other) != code_mark(Failing) and code_mark(None) != code_mark("None")
    assert code_mark(made(made)) and code_mark({"a": {1, 2}}) == code_mark({"a": {2, 1}})


def test_an_unfinished_run_goes_on(spark, tmp_path):
    rows, where = texts(spark, 12), f"file://{tmp_path}/out"
    part = annotate_dataset(rows, where, spec(), "{text}", wave_rows=3, max_waves=2, version="1")
    assert part.count() == 6 and not src.exists(spark, f"{where}/final")
    assert annotate_dataset(rows, where, spec(), "{text}", version="1").count() == 12
    whole = annotate_dataset(rows, f"{where}2", spec(), "{text}", wave_rows=6, max_waves=2, version="1")
    assert whole.count() == 12 and src.exists(spark, f"{where}2/final/_SUCCESS")


def test_a_step_belongs_to_its_configuration(spark, tmp_path):
    texts(spark, 4).write.parquet(f"file://{tmp_path}/in")
    steps = lambda first, second: [{"name": "a", "prompt": first, "rename": {"a_response": "said"}}, {"name": "b", "prompt": second}]
    config = lambda *prompts: PipelineConfig(f"file://{tmp_path}/out", steps(*prompts), DatasetConfig(path=f"file://{tmp_path}/in"), {"provider": "echo"})
    said = lambda c, **more: sorted(r.b_response for r in run_pipeline(spark, c, **more).collect())
    assert said(config("A {text}", "B {said}"))[0] == "B A document 0"
    assert said(config("A {text}", "C {said}"))[0] == "C A document 0"
    assert said(config("D {text}", "C {said}"))[0] == "C D document 0"
    with pytest.raises(RuntimeError, match="another configuration"):
        run_pipeline(spark, config("E {text}", "C {said}"), ["b"])
    spark.createDataFrame([(9, "document 9")], "k long, text string").write.mode("append").parquet(f"file://{tmp_path}/in")
    assert len(said(config("D {text}", "C {said}"))) == 5
    with pytest.raises(RuntimeError, match="not finished"):
        run_pipeline(spark, config("F {text}", "C {said}"), wave_rows=2, max_waves=1)


# Leases.


class Logged(LastMessageProvider):
    """Writes when it begins and ends a batch of a server."""

    def __init__(self, model="", base_url="", log="", **kwargs):
        super().__init__(model, **kwargs)
        self.base_url, self.log = base_url, log

    def batch(self, batch, options, **extra):
        with open(self.log, "a") as f:
            f.write(f"{time.time()} 1 {self.base_url}\n")
        time.sleep(0.05)
        with open(self.log, "a") as f:
            f.write(f"{time.time()} -1 {self.base_url}\n")
        return super().batch(batch, options, **extra)


@pytest.mark.parametrize("queue, limit", [(2, 1), (4, 2)])
def test_tasks_share_the_places_at_servers(spark, tmp_path, queue, limit):
    log = str(tmp_path / "log")
    s = spec(ProviderSpec(Logged, init={"log": log}, base_urls=("a", "b")), batch_size=2, queue_size=queue)
    found = run_annotation(prepared(spark, 80), s, Progress(spark, f"file://{tmp_path}/run"), partitions=8)
    assert found.count() == 80
    running, most = collections.Counter(), collections.Counter()
    for line in sorted(open(log).read().split("\n")[:-1], key=lambda x: float(x.split()[0])):
        _, step, server = line.split()
        running[server] += int(step)
        most[server] = max(most[server], running[server])
    assert set(most) == {"a", "b"} and max(most.values()) <= limit and not any(running.values())


def test_places_of_the_dead_return():
    with LeaseBroker(1, 1) as broker:
        dead, alive = Leases(broker.address), Leases(broker.address)
        assert dead.take() == 0
        got = []
        waiting = threading.Thread(target=lambda: got.append(alive.take()))
        waiting.start()
        time.sleep(0.3)
        assert not got
        dead.close()  # what the end of a task's process does to its connections
        waiting.join(10)
        assert got == [0]
        # One that dies while it waits takes none.
        third = Leases(broker.address)
        impatient = threading.Thread(target=lambda: pytest.raises(Exception, third.take))
        impatient.start()
        time.sleep(0.3)
        for link, _ in third.all:
            link.shutdown(2)
        impatient.join(10)
        alive.close()
        fourth = Leases(broker.address)
        assert fourth.take() == 0
        fourth.give()
        assert fourth.take() == 0


def test_servers_that_are_away_are_put_aside_for_all():
    with LeaseBroker(2, 1, away=0.5) as broker:
        one, two = Leases(broker.address), Leases(broker.address, 1)
        assert {one.take(), two.take()} == {0, 1}
        one.give(reached=False)
        two.give(reached=False)
        assert one.take() is None and one.take() is None
        time.sleep(0.7)
        assert one.take() in (0, 1)
        stranger = Leases(type(broker.address)(broker.host, broker.port, "guess"))
        with pytest.raises(ConnectionError):
            stranger.take()


def test_a_pool_with_leases_answers_all(spark):
    with LeaseBroker(2, 2) as broker, ServerPool([LastMessageProvider, LastMessageProvider], leases=Leases(broker.address)) as pool:
        assert sorted(pool.run(iter(range(40)), lambda client, b: b * 2, 4)) == [(k, 2 * k) for k in range(40)]
        assert not any(broker.busy.values())


# Order of the source.


def test_source_order_of_many_files(spark, tmp_path):
    """Rows with the same values in every column but one keep the places that they have in their files."""
    rows = spark.range(1000).select((F.col("id") % 3).alias("tied"), F.lit("t").alias("text"), F.col("id").alias("at")).repartitionByRange(7, "at").sortWithinPartitions("at")
    rows.write.option("maxRecordsPerFile", 60).parquet(f"file://{tmp_path}/in")
    df = spark.read.parquet(f"file://{tmp_path}/in")
    found = in_source_order(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "SortMergeJoin" not in plan
    assert all(r.idx == r["at"] for r in found.collect()) and found.count() == 1000
    part = in_source_order(df.filter("at % 2 = 1").select("text", "at"))
    assert all(2 * r.idx + 1 == r["at"] for r in part.collect()) and part.columns == ["idx", "text", "at"]
    df.select("text", "at").coalesce(2).sortWithinPartitions("at").write.json(f"file://{tmp_path}/lines")
    lines = in_source_order(spark.read.json(f"file://{tmp_path}/lines"))
    assert sorted(r.idx for r in lines.collect()) == list(range(1000))


def test_source_order_in_pieces_of_a_file(spark, tmp_path):
    spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1).write.option("parquet.block.size", 65536).parquet(f"file://{tmp_path}/in")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        assert in_source_order(spark.read.parquet(f"file://{tmp_path}/in")).filter("idx <> id").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_source_order_in_memory_and_elsewhere(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("a", 2), ("c", None)], "x string, y int")
    assert [(r.x, r.idx) for r in in_source_order(rows).orderBy("idx").collect()] == [("b", 0), ("a", 1), ("a", 2), ("c", 3)]
    assert in_source_order(rows.groupBy("x").count()) is None
    tied = rows.groupBy("x", "y").count().withColumn("z", F.lit(1)).select("z", "x")
    one, two = ([(r.idx, r.x) for r in numbered(tied.repartition(k)).orderBy("idx").collect()] for k in (1, 3))
    assert one == two and [k for k, _ in one] == [0, 1, 2]
    assert [r.idx for r in in_source_order(spark.range(5), "idx").orderBy("id").collect()] == list(range(5))
    assert in_source_order(rows.filter("y > 9")).count() == 0
