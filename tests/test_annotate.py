import json
import os
import subprocess
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import tables as R
from millrace.operators.annotate import AnnotateSpec, annotate, annotate_rows, in_flight, parsed
from millrace.operators.progress import Progress, import_jsonl, run_annotation, write_metadata
from millrace.plans.annotator import annotate_dataset, generate_dataset
from millrace.plans.prepare import PrepareSpec, assign_index, prepare, prepare_data
from millrace.providers import Provider, ProviderSpec, Response, UnavailableError
from millrace.providers.base import Keeper
from millrace.providers.pool import ServerPool
from millrace.queries import LastMessageProvider
from millrace.sources import tables as src
from millrace.streaming.resume import annotate_stream, read_stream_results
from tests.conftest import ROOT

LABEL = {"type": "object", "properties": {"label": {"type": "string"}}, "required": ["label"]}


class CountingProvider(LastMessageProvider):
    """Writes a line to a file for each prompt; ``crash`` stops the run."""

    def __init__(self, model="", log=None, **kwargs):
        super().__init__(model, **{"on_error": "raise", **kwargs})
        self.log = log

    def generate(self, messages, options, **extra):
        with open(self.log, "a") as f:
            f.write(messages[-1]["content"] + "\n")
        return super().generate(messages, options, **extra)


class ShortProvider(LastMessageProvider):
    def batch(self, batch, options, **extra):
        return super().batch(batch[1:], options, **extra)


def texts(spark, n=13):
    return spark.createDataFrame([(k, f"document {k}") for k in range(n)], "k long, text string")


def prepared(spark, n=13, template="{text}"):
    return prepare(texts(spark, n).withColumn("idx", F.col("k")), PrepareSpec(template, keep_columns=("text",)))


def spec(provider="echo", **options):
    made = provider if isinstance(provider, ProviderSpec) else ProviderSpec(provider)
    return AnnotateSpec(made, keep_columns=("text",), **options)


def response(text, **kwargs):
    return Response(text, "stop", **kwargs)


@pytest.mark.parametrize(
    "text, valid, label",
    [('{"label": "a"}', True, "a"), ('{"label": null}', True, None), ("{}", False, None), ("not json", False, None), ('{"label": "a"} x', False, None), ("[1]", False, None), ("null", False, None), ('{"label":1,"label":2}', True, "2"), ('{"label": NaN}', True, "NaN")],
)
def test_parsing(text, valid, label):
    row = parsed(spec(output_schema=LABEL), response(text))
    assert (row["valid_fields"], row["label"]) == (valid, label)


def test_parsing_of_errors_and_open_schemas():
    assert parsed(spec(output_schema=LABEL), response('{"label": "a"}', error="cut"))["valid_fields"] is False
    free = {"type": "object", "properties": {"label": {"type": "string"}}}
    row = parsed(spec(output_schema=free), response('{"label": "a", "more": 1}'))
    assert row["valid_fields"] is None and json.loads(row["extra"]) == {"more": 1}


def test_only_invalid_rows_are_retried():
    s = spec("scripted", output_schema=LABEL)
    provider = s.provider.build()
    rows = [{"messages": [{"role": "user", "content": t}]} for t in ("fine", "fail:2 x", "fail:9 y", "length z")]
    got = annotate_rows(s, provider, rows)
    assert [r["valid_fields"] for r in got] == [True, True, False, False]
    assert provider.attempts == {"fine": 1, "fail:2 x": 3, "fail:9 y": 6, "length z": 6}
    assert got[3]["error_type"] == "ProviderError" and got[3]["response"].startswith('{"label"')


def test_a_null_verdict_is_retried_unless_allowed():
    free = {"type": "object", "properties": {"label": {"type": "string"}}}
    rows = [{"messages": [{"role": "user", "content": "fine"}]}]
    for allowed, times in ((False, 6), (True, 1)):
        s = spec("scripted", output_schema=free, null_validity_is_ok=allowed)
        provider = s.provider.build()
        annotate_rows(s, provider, rows)
        assert provider.attempts == {"fine": times}


def test_hooks_are_checked():
    rows = [{"messages": [{"role": "user", "content": "a"}]}]
    for hooks in ({"validate": lambda r: 1}, {"postprocess": lambda r: 1}):
        s = spec(**hooks)
        with pytest.raises(TypeError):
            annotate_rows(s, s.provider.build(), rows)
    s = spec(validate=lambda r: r["response"] == "a")
    assert annotate_rows(s, s.provider.build(), rows)[0]["valid"] is True


def test_columns_and_order(spark):
    out = annotate(prepared(spark), spec(output_schema=LABEL, task_prefix=""))
    assert out.columns == ["idx", "text", "messages", "response", "finish_reason", "num_tokens", "error", "error_type", "valid_fields", "label", "extra"]
    assert {r.label for r in out.collect()} == {f"label::document {k}" for k in range(13)}


def test_results_take_the_place_of_inputs(spark):
    rows = prepared(spark, 2).withColumn("label", F.lit("old"))
    out = annotate(rows, AnnotateSpec(ProviderSpec("echo"), output_schema=LABEL, keep_columns=True))
    assert out.columns.count("label") == 1 and {r.label for r in out.collect()} == {"label::document 0", "label::document 1"}


@pytest.mark.parametrize("partitions, batch", [(1, 1), (3, 4), (7, 256)])
def test_any_dealing_gives_the_same_rows(spark, partitions, batch):
    out = annotate(prepared(spark).repartition(partitions), spec(batch_size=batch))
    assert sorted((r.idx, r.response) for r in out.collect()) == [(k, f"document {k}") for k in range(13)]


def test_too_few_answers_stop_the_run(spark):
    with pytest.raises(Exception, match="gave 12 answers to 13 prompts"):
        annotate(prepared(spark).coalesce(1), spec(ProviderSpec(ShortProvider))).collect()


def test_resume_asks_only_what_is_missing(spark, tmp_path):
    log = str(tmp_path / "log")
    s = spec(ProviderSpec(CountingProvider, init={"log": log}))
    progress = Progress(spark, f"file://{tmp_path}/run")
    part = run_annotation(prepared(spark), s, progress, wave_rows=4, max_waves=2)
    assert part.count() == len(open(log).readlines()) == 8
    whole = run_annotation(prepared(spark), s, progress, wave_rows=4)
    assert [r.idx for r in whole.collect()] == list(range(13)) and len(open(log).readlines()) == 13
    again = run_annotation(prepared(spark), s, progress)
    assert again.collect() == whole.collect() and len(open(log).readlines()) == 13
    assert "written_at" not in whole.columns


def test_an_uncommitted_wave_does_not_count(spark, tmp_path):
    progress = Progress(spark, f"file://{tmp_path}/run")
    run_annotation(prepared(spark), spec(), progress, wave_rows=5)
    os.remove(tmp_path / "run/manifest/00000001")
    assert run_annotation(prepared(spark), spec(), progress).count() == 13


def test_errors_count_as_done_unless_told(spark, tmp_path):
    rows = prepared(spark, 4, "error {text}")
    progress = Progress(spark, f"file://{tmp_path}/run")
    first = run_annotation(rows, spec("scripted"), progress)
    assert first.filter("error is not null").count() == 4
    assert run_annotation(rows, spec(), progress).filter("error is not null").count() == 4
    run_annotation(rows, spec(), progress, retry_errors=True)
    assert progress.read().count() == 8


def test_backup_is_read_where_progress_is_gone(spark, tmp_path):
    log = str(tmp_path / "log")
    s = spec(ProviderSpec(CountingProvider, init={"log": log}))
    run_annotation(prepared(spark), s, Progress(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b"))
    out = run_annotation(prepared(spark), s, Progress(spark, f"file://{tmp_path}/c", f"file://{tmp_path}/b"))
    assert out.count() == 13 and len(open(log).readlines()) == 13


def test_overlapping_waves_keep_the_first(spark, tmp_path):
    progress = Progress(spark, f"file://{tmp_path}/run")
    run_annotation(prepared(spark, 3), spec(), progress)
    progress.append(annotate(prepared(spark, 5, "late {text}"), spec()))
    out = run_annotation(prepared(spark, 5), spec(), progress)
    assert [r.response.startswith("late") for r in out.collect()] == [False, False, False, True, True]


def test_older_progress_files(spark, tmp_path):
    schema = T.StructType.fromDDL("idx long, response string")
    (tmp_path / "p_0.jsonl").write_text('{"idx": 0, "response": "a"}\n{"idx": 1, "response": "b"}\n{"idx": 2, "resp')
    (tmp_path / "p_1.jsonl").write_text("")
    assert sorted(map(tuple, import_jsonl(spark, f"file://{tmp_path}", schema).collect())) == [(0, "a"), (1, "b")]
    assert not (tmp_path / "p_1.jsonl").exists()
    (tmp_path / "p_2.jsonl").write_text('{"idx": 3\n{"idx": 4, "response": "c"}\n')
    with pytest.raises(ValueError, match="line 1 is not JSON"):
        import_jsonl(spark, f"file://{tmp_path}", schema)
    (tmp_path / "p_2.jsonl").write_text('{"response": "c"}\n')
    with pytest.raises(ValueError, match="has no 'idx'"):
        import_jsonl(spark, f"file://{tmp_path}", schema)


def test_jsonl_reading(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "txt": "x", "extra": 1}\nbroken\n{"id": 2, "txt": "y"}\n{"id": 3, "txt": "x"}\n\n')
    good, bad = src.read_jsonl(spark, f"file://{tmp_path}", T.StructType.fromDDL("id long, txt string, extra long"), ["id", "txt"], "txt")
    assert sorted(map(tuple, good.collect())) == [(1, "x"), (2, "y")] and bad.count() == 1


def test_prepare_order_limit_and_checks(spark):
    rows = texts(spark, 20)
    one = prepare(rows, PrepareSpec("{text}", order_by=("k",), shuffle_seed=7, max_samples=6)).collect()
    two = prepare(rows.repartition(5), PrepareSpec("{text}", order_by=("k",), shuffle_seed=7, max_samples=6)).collect()
    assert one == two and len(one) == 6 and [r.idx for r in one] != sorted(r.idx for r in one)
    assert all(r.messages[0].content == f"document {r.idx}" for r in one)
    assert [r.idx for r in prepare(rows, PrepareSpec("{text}", order_by=("k",), sort_by_length=True)).limit(1).collect()] == [10]
    with pytest.raises(ValueError, match="not among"):
        prepare(rows, PrepareSpec("{nope}", order_by=("k",)))
    with pytest.raises(ValueError, match="positive"):
        prepare(rows, PrepareSpec("{text}", order_by=("k",), max_samples=0))
    with pytest.raises(ValueError, match="exists already"):
        assign_index(rows.withColumn("idx", F.lit(1)), ["k"])
    assert sorted((r.k, r.idx) for r in assign_index(rows.repartition(3), ["k"]).collect()) == [(k, k) for k in range(20)]


def test_index_over_many_ranges(spark):
    rows = spark.range(9000).selectExpr("CASE WHEN id % 7 > 0 THEN id % 50 END AS a", "cast(id AS string) AS b").repartition(6)
    got = assign_index(rows, ["a", "b"]).collect()
    ordered = sorted(got, key=lambda r: (r.a is not None, r.a or 0, r.b))
    assert [r.idx for r in ordered] == list(range(9000))


def test_prepared_data_are_kept_and_rebuilt(spark, tmp_path):
    rows = texts(spark, 3).withColumn("idx", F.col("k"))
    rows.write.parquet(f"file://{tmp_path}/src")
    rows = spark.read.parquet(f"file://{tmp_path}/src")
    path = f"file://{tmp_path}/prepared"
    prepare_data(rows, PrepareSpec("A {text}"), path)
    stamp = os.path.getmtime(tmp_path / "prepared/data/_SUCCESS")
    assert prepare_data(rows, PrepareSpec("A {text}"), path).count() == 3 and os.path.getmtime(tmp_path / "prepared/data/_SUCCESS") == stamp
    changed = prepare_data(rows, PrepareSpec("B {text}"), path).orderBy("idx").collect()
    assert changed[0].messages[0].content == "B document 0"


def test_annotate_and_generate(spark, tmp_path):
    out = annotate_dataset(texts(spark, 3), f"file://{tmp_path}/a", spec(), "Say {text}", prepare_options={"order_by": ("k",)})
    assert [r.response for r in out.orderBy("idx").collect()] == [f"Say document {k}" for k in range(3)]
    assert json.loads((tmp_path / "a/metadata.json").read_text())["counts"]["finish_reason"] == {"stop": 3}
    with pytest.raises(ValueError, match="one of"):
        annotate_dataset(texts(spark), "x", spec(), "a", full_prompt_template="b")
    with pytest.raises(TypeError):
        annotate_dataset(texts(spark), "x", spec())
    made = generate_dataset(spark, "Write", f"file://{tmp_path}/g", AnnotateSpec(ProviderSpec("echo")), 4)
    assert made.count() == 4 and {r.response for r in made.collect()} == {"Write"}
    with pytest.raises(ValueError):
        generate_dataset(spark, [], f"file://{tmp_path}/h", AnnotateSpec(ProviderSpec("echo")))


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", True), (2, "b", None), (3, "a", False)], "i int, s string, valid_fields boolean")
    assert [r.i for r in R.filter_invalid(rows).collect()] == [1]
    assert sorted(r.i for r in R.dedup_by_hash(rows, "s", ["i"]).collect()) == [1, 2]
    for bad in (lambda: R.rename(rows, {"x": "y"}), lambda: R.rename(rows, {"i": "s"}), lambda: R.drop(rows, ["x"]), lambda: R.filter_invalid(rows.drop("valid_fields"))):
        with pytest.raises(ValueError):
            bad()
    assert R.rename(rows, {"i": "s", "s": "i"}).columns == ["s", "i", "valid_fields"]
    assert src.rotated_name("o", 2500, 1000) == "o_2.jsonl" and src.rotated_name("o", 5, 0) == "o.jsonl"
    assert write_metadata(rows, f"file://{tmp_path}")["counts"] == {"valid_fields": {"valid": 1, "invalid": 1, "none": 1}}
    assert in_flight(None, 3) == 12 and in_flight(2, 3) == 3
    with pytest.raises(ValueError):
        in_flight(0, 1)


def test_streaming_resumes(spark, tmp_path):
    log = str(tmp_path / "log")
    s = spec(ProviderSpec(CountingProvider, init={"log": log}))
    rows = prepared(spark, 5)
    for k in (0, 1):
        rows.filter(F.col("idx") % 2 == k).write.mode("append").parquet(f"file://{tmp_path}/in")
        for _ in range(2):
            source = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
            annotate_stream(source, s, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    assert sorted(r.idx for r in read_stream_results(spark, f"file://{tmp_path}/out").collect()) == list(range(5))
    assert len(open(log).readlines()) == 5


def test_splits_and_prompts(spark, tmp_path):
    rows = texts(spark, 4).withColumn("split", F.when(F.col("k") < 3, "train").otherwise("test"))
    assert src.load_dataset(spark, data=rows, split="test").count() == 1
    for bad in ({"data": rows}, {"data": rows, "split": "dev"}, {}, {"data": rows, "name": "x"}):
        with pytest.raises(ValueError):
            src.load_dataset(spark, **bad)
    (tmp_path / "p.txt").write_text("one\n\n two\n")
    assert [r.prompt for r in src.read_prompts(spark, f"file://{tmp_path}/p.txt").collect()] == ["one", " two"]
    assert src.count_lines(spark, f"file://{tmp_path}/p.txt") == 3
    assert isinstance(spec().provider.build(), Provider)


def source(spark, tmp_path, n=8):
    texts(spark, n).withColumn("idx", F.col("k")).write.mode("overwrite").parquet(f"file://{tmp_path}/src")
    return spark.read.parquet(f"file://{tmp_path}/src")


def test_a_fingerprint_is_the_same_in_another_session(spark, tmp_path):
    rows = source(spark, tmp_path)
    mark = PrepareSpec("A {text}").fingerprint(rows.filter("k > 1"))
    code = f"""
from pyspark.sql import SparkSession
from millrace.plans.prepare import PrepareSpec
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
spark.range(3).count()
print("mark", PrepareSpec("A {{text}}").fingerprint(spark.read.parquet("file://{tmp_path}/src").filter("k > 1")))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, capture_output=True, text=True, timeout=300).stdout
    assert out.split("mark ")[1].strip() == mark
    others = [PrepareSpec("B {text}").fingerprint(rows.filter("k > 1")), PrepareSpec("A {text}").fingerprint(rows.filter("k > 2")), PrepareSpec("A {text}").fingerprint(rows.filter("k > 1"), lambda d: d)]
    rows.limit(3).write.mode("append").parquet(f"file://{tmp_path}/src")
    others.append(PrepareSpec("A {text}").fingerprint(spark.read.parquet(f"file://{tmp_path}/src").filter("k > 1")))
    assert len({mark, *others}) == 5
    one, two = (spark.createDataFrame([(k, t)], "k long, text string") for k, t in ((1, "a"), (1, "b")))
    assert PrepareSpec("{text}").fingerprint(one) != PrepareSpec("{text}").fingerprint(two)
    assert PrepareSpec("{text}").fingerprint(one, version="7") == PrepareSpec("{text}").fingerprint(two, version="7")


def test_results_belong_to_their_inputs(spark, tmp_path):
    rows, where = source(spark, tmp_path), f"file://{tmp_path}/out"
    said = lambda df: sorted(r.response for r in df.collect())
    annotate_dataset(rows, where, spec(), "A {text}", wave_rows=3, max_waves=1)
    assert said(annotate_dataset(rows, where, spec(), "B {text}")) == [f"B document {k}" for k in range(8)]
    assert said(annotate_dataset(rows.filter("k < 2"), where, spec(), "B {text}")) == ["B document 0", "B document 1"]
    assert said(annotate_dataset(rows, where, spec(), "B {text}")) == [f"B document {k}" for k in range(8)]
    logs = [str(tmp_path / name) for name in ("one", "two")]
    for log in logs:
        counting = spec(ProviderSpec(CountingProvider, init={"log": log}))
        assert said(annotate_dataset(rows, where, counting, "B {text}")) == [f"B document {k}" for k in range(8)]
    assert os.path.exists(logs[0]) and not os.path.exists(logs[1])
    assert [r.label for r in annotate_dataset(rows, where, spec(output_schema=LABEL), "B {text}").orderBy("idx").collect()] == [f"label::B document {k}" for k in range(8)]


def test_progress_of_a_split_counts_for_it_alone(spark, tmp_path):
    progress = Progress(spark, f"file://{tmp_path}/run")
    run_annotation(prepared(spark, 6), spec(), progress, dataset_split="train")
    other = run_annotation(prepared(spark, 6, "test {text}"), spec(), progress, dataset_split="test")
    assert [r.response for r in other.collect()] == [f"test document {k}" for k in range(6)]
    again = run_annotation(prepared(spark, 6, "again {text}"), spec(), progress, dataset_split="train")
    assert [r.response for r in again.collect()] == [f"document {k}" for k in range(6)] and "dataset_split" not in again.columns


def test_waves_do_not_scan_what_they_do_not_hold(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = prepared(spark, 500)
    out = run_annotation(rows.mapInArrow(count, rows.schema), spec(), Progress(spark, f"file://{tmp_path}/run"), wave_rows=10)
    assert out.count() == 500 and seen.value <= 2 * 500
    assert len(src.list_files(spark, f"file://{tmp_path}/run/manifest")) == 50 and not os.path.exists(tmp_path / "run/todo")


def test_older_progress_is_imported_into_a_run(spark, tmp_path):
    os.makedirs(tmp_path / "old")
    (tmp_path / "old/p_0.jsonl").write_text('{"idx": 0, "text": "t", "response": "old"}\n{"idx": 2, "response": "older"}\n')
    out = annotate_dataset(source(spark, tmp_path, 4), f"file://{tmp_path}/out", spec(), "{text}", import_from=f"file://{tmp_path}/old")
    assert [r.response for r in out.orderBy("idx").collect()] == ["old", "document 1", "older", "document 3"]


def test_backups_gather_and_files_rotate(spark, tmp_path):
    progress = Progress(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b", rows_per_file=2, backup_every=7)
    for k in range(3):
        progress.append(annotate(prepared(spark, 4).coalesce(1), spec()))
        assert len(src.list_files(spark, f"file://{tmp_path}/b/manifest")) == (0, 2, 2)[k]
    progress.copy_pending()
    assert len(progress.waves(progress.backup)) == 3 and len(src.list_files(spark, f"file://{tmp_path}/a/progress/wave=00000000", ".parquet")) == 2


class Served(LastMessageProvider):
    def __init__(self, model="", base_url="", **kwargs):
        super().__init__(model, **{"on_error": "ignore", **kwargs})
        self.base_url = base_url

    def batch(self, batch, options, **extra):
        time.sleep(0.2 if self.base_url == "slow" else 0.0)
        return super().batch(batch, options, **extra)

    def generate(self, messages, options, **extra):
        if self.base_url == "down":
            raise UnavailableError("no route")
        return Response(self.base_url, "stop")


def test_a_free_server_takes_the_next_batch(spark):
    pool = lambda *urls, **more: spec(ProviderSpec(Served, base_urls=urls), batch_size=2, **more)
    rows = prepared(spark, 80).coalesce(1)
    took = {r.response: r.n for r in annotate(rows, pool("down", "slow", "quick")).groupBy("response").agg(F.count("*").alias("n")).collect()}
    assert set(took) <= {"slow", "quick"} and sum(took.values()) == 80 and took["quick"] > 4 * took.get("slow", 0)
    assert sorted(r.idx for r in annotate(rows, pool("quick", "slow", queue_size=2)).collect()) == list(range(80))
    lost = annotate(prepared(spark, 4), pool("down", "down")).collect()
    assert len(lost) == 4 and {r.error_type for r in lost} == {"UnavailableError"}
    with pytest.raises(Exception, match="no route"):
        annotate(prepared(spark, 4), spec(ProviderSpec(Served, init={"on_error": "raise"}, base_urls=("down", "down")))).collect()


def test_pools_bound_what_is_in_flight():
    running, most, lock = [0], [0], threading.Lock()

    def work(client, batch):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.01)
        with lock:
            running[0] -= 1
        return batch * 2

    taken = []
    with ServerPool([Served] * 8) as pool:
        found = sorted(pool.run((taken.append(k) or k for k in range(30)), work, 3))
    assert found == [(k, 2 * k) for k in range(30)] and most[0] <= 3 and len(taken) == 30


class Built(LastMessageProvider):
    """Writes its process to a file when it is built."""

    def __init__(self, model="", log=None, **kwargs):
        super().__init__(model, **kwargs)
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")


def test_a_worker_builds_a_client_once_for_tasks_and_steps(spark, tmp_path):
    logs = [str(tmp_path / name) for name in ("one", "two")]
    made = lambda log, reuse: spec(ProviderSpec(Built, init={"log": log}, reuse=reuse))
    for _ in range(3):
        assert annotate(prepared(spark, 40).repartition(8), made(logs[0], "key")).count() == 40
    assert annotate(prepared(spark, 8).repartition(8), made(logs[1], "other")).count() == 8
    for log in logs:
        built = open(log).read().split()
        assert len(built) == len(set(built))


def test_a_keeper_closes_what_goes():
    closed = []

    class Client(LastMessageProvider):
        def close(self):
            closed.append(self.model)

    class Engine(Client):
        holds_engine = True

    keeper = Keeper(2)
    get = lambda name, kind=Client: keeper.get(name, lambda: kind(name), kind.holds_engine)
    first = get("a")
    assert get("a") is first and get("e", Engine) is not first and not closed
    assert get("f", Engine) and closed == ["e"]
    assert get("a") is first and get("b") and closed == ["e", "f"]
    a, b = ProviderSpec(Served, reuse="test a"), ProviderSpec(Served, reuse="test b")
    assert a.build() is a.build(3) is not b.build() and ProviderSpec(Served).build() is not ProviderSpec(Served).build()


def test_an_uncommitted_micro_batch_does_not_count(spark, tmp_path):
    rows = prepared(spark, 4)
    rows.write.parquet(f"file://{tmp_path}/in")
    annotate_stream(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), spec(), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    annotate(prepared(spark, 9), spec()).write.parquet(f"file://{tmp_path}/out/batch=7")
    os.remove(tmp_path / "out/batch=7/_SUCCESS")
    assert read_stream_results(spark, f"file://{tmp_path}/out").count() == 4 and read_stream_results(spark, f"file://{tmp_path}/none") is None
