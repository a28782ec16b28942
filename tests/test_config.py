import json

import pytest

from millrace.cli import main
from millrace.config import ClientConfig, DatasetConfig, EngineConfig, PipelineConfig, StepConfig, catalog_text, load_file, load_pipeline, strict
from millrace.logs import configure, get_logger, level_of
from millrace.pipeline import run_pipeline, selection, serve_args, with_hosts

QA = {"type": "object", "properties": {"question": {"type": "string"}, "answer": {"type": "string"}}, "required": ["question", "answer"]}
RATING = {"type": "object", "properties": {"rating": {"type": "integer"}}, "required": ["rating"]}


@pytest.mark.parametrize(
    "bad",
    [{"provider": "open-ai", "model": "m"}, {"provider": "openai"}, {"provider": "claude", "model": "m", "base_urls": ["u"]}, {"provider": "vllm_online", "base_urls": ["u"], "url_glob": "g"}, {"provider": "openai", "model": "m", "engine": {"max_model_len": 1}}, {"model": "m", "init": {"max_model_len": 1}}, {"model": "m", "options": {"nope": 1}}, {"model": "m", "batch_size": 0}, {"model": "m", "engine": {"nope": 1}}, {"model": "m", "pool": {"gpus_per_vllm_server": 1}}, {"nope": 1}],
)
def test_bad_clients(bad):
    with pytest.raises(ValueError):
        strict(ClientConfig, bad, "client")


def test_kinds_and_keys():
    kind = lambda **k: strict(ClientConfig, k, "client").kind()
    assert kind(provider="vllm_online") == "vllm_pool" and kind(provider="vllm_online", base_urls=["u"]) == "vllm_online"
    assert kind(model="m") == "vllm_offline" and kind(provider="claude", model="m") == "api"
    a = ClientConfig(model="m", options={"seed": 1})
    assert a.reuse_key() == ClientConfig(model="m", batch_size=3).reuse_key() != ClientConfig(model="m", engine={"max_model_len": 9}).reuse_key()


def test_serve_flags():
    e = EngineConfig(max_model_len=4096, enforce_eager=False, enable_prefix_caching=True, speculative_config={"a": [1]}, extra={"swap_space": 4})
    assert e.serve_args() == ["--tensor-parallel-size", "1", "--max-model-len", "4096", "--no-enforce-eager", "--enable-prefix-caching", "--speculative-config", '{"a":[1]}', "--swap-space", "4"]


@pytest.mark.parametrize(
    "bad",
    [{"name": " ", "prompt": "p"}, {"name": "a"}, {"name": "a", "prompt": "p", "prompt_file": "f"}, {"name": "a", "prompt": "p", "prompts": ["x"]}, {"name": "a", "type": "generate"}, {"name": "a", "prompt": "p", "filter_invalid": True}, {"name": "a", "prompt": "p", "sort_by_length": "down"}, {"name": "a", "prompt": "p", "nope": 1}, {"name": "a", "type": "other", "prompt": "p"}],
)
def test_bad_steps(bad):
    with pytest.raises(ValueError):
        strict(StepConfig, bad, "step")


def step(name, **more):
    return {"name": name, "prompt": "{text}", **more}


@pytest.mark.parametrize(
    "bad",
    [{"steps": []}, {"steps": [step("a"), step("a")]}, {"steps": [step("a", task_prefix="x"), step("b", task_prefix="x")]}, {"steps": [step("a"), {"name": "g", "type": "generate", "prompts": ["x"]}]}, {"steps": [step("a")], "dataset": None}, {"steps": [{"name": "g", "type": "generate", "prompts": ["x"]}]}, {"steps": [step("a", client={"provider": "openai"})], "client": {}}, {"steps": [step("a")], "dataset": {"name": "n", "path": "p"}}],
)
def test_bad_pipelines(bad):
    with pytest.raises(ValueError):
        PipelineConfig(**{"output_dir": "o", "client": {"provider": "echo"}, "dataset": {"path": "p"}, **bad})
    with pytest.raises(ValueError):
        DatasetConfig()


def test_clients_are_merged():
    config = PipelineConfig("o", [step("a", client={"options": {"seed": 1}}), step("b", client={"provider": "openai", "model": "n"})], DatasetConfig(path="p"), {"model": "m", "batch_size": 4, "options": {"seed": 0, "top_p": 0.5}, "init": {"x": 1}})
    a, b = (config.step_client(s) for s in config.steps)
    assert (a.model, a.options, a.init, a.batch_size) == ("m", {"seed": 1, "top_p": 0.5}, {"x": 1}, 4)
    assert (b.model, b.options, b.init, b.batch_size) == ("n", {}, {}, 4)
    assert [d["kind"] for d in config.describe()] == ["vllm_offline", "api"]


def test_files(tmp_path):
    (tmp_path / "c.yaml").write_text("output_dir: out\nclient: {provider: vllm_online, model: m}\ndataset: {path: d}\nsteps:\n- {name: a, prompt_file: p.json}\n")
    (tmp_path / "p.json").write_text(json.dumps({"instruction": "Pick:", "codes": [{"code": "x", "description": "the x"}, {"code": "y"}]}))
    config = load_pipeline(tmp_path / "c.yaml", log_level="DEBUG")
    assert config.output_dir == str(tmp_path / "out") and config.log_level == "DEBUG" and config.step_dir(0).endswith("out/01-a")
    assert config.steps[0].template(tmp_path) == "Pick:\n- `x` — the x\n- `y`" == catalog_text(json.loads((tmp_path / "p.json").read_text()))
    (tmp_path / "hosts").write_text("http://a/v1\n\n http://b/v1 \n")
    pointed = load_pipeline(tmp_path / "c.yaml", with_hosts(config, str(tmp_path / "hosts")))
    assert pointed.step_client(pointed.steps[0]).urls(tmp_path) == ["http://a/v1", "http://b/v1"]
    assert ClientConfig("vllm_online", url_glob="ho*").urls(tmp_path) == ["http://a/v1", "http://b/v1"]
    with pytest.raises(ValueError):
        ClientConfig("vllm_online", url_glob="none*").urls(tmp_path)
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(ValueError):
        load_file(tmp_path / "bad.json")
    with pytest.raises(FileNotFoundError):
        load_file(tmp_path / "none.yaml")


def test_prompts_of_generate_steps(tmp_path):
    made = lambda **k: StepConfig("g", "generate", **k).all_prompts(tmp_path)
    (tmp_path / "p.txt").write_text("a\n\nb\n")
    assert made(prompts=["x"], num_samples=3) == ["x"] * 3 and made(prompts=["x", "y", "z"], num_samples=2) == ["x", "y"] and made(prompts="p.txt") == ["a", "b"]
    with pytest.raises(ValueError):
        made(prompts=[])


def two_steps(tmp_path, **more):
    steps = [{"name": "write", "prompt": "Ask about {text}", "output_schema": QA, "filter_invalid": True, "rename": {"question": "question_v1"}, "drop_columns": ["write_error"]}, {"name": "rate", "prompt": "Rate {question_v1}", "output_schema": RATING, "keep_messages": True}]
    return PipelineConfig(f"file://{tmp_path}/out", steps, DatasetConfig(path=f"file://{tmp_path}/src"), {"provider": "echo"}, **more)


def test_a_pipeline_runs_resumes_and_selects(spark, tmp_path):
    spark.createDataFrame([(f"document {k}",) for k in range(4)], "text string").write.parquet(f"file://{tmp_path}/src")
    config = two_steps(tmp_path)
    assert selection(config, ["rate"]) == [1]
    with pytest.raises(ValueError):
        selection(config, ["nope"])
    with pytest.raises(RuntimeError, match="not finished"):
        run_pipeline(spark, config, ["rate"])
    first = run_pipeline(spark, config, ["write"])
    assert "question_v1" in first.columns and "write_error" not in first.columns and "write_messages" not in first.columns
    assert not (tmp_path / "out/final").exists()
    stamp = (tmp_path / "out/01-write/output/_SUCCESS").stat().st_mtime
    done = run_pipeline(spark, config)
    rows = done.orderBy("idx").collect()
    assert rows[0].rating == 4 and rows[0].question_v1 == "question::Ask about document 0" and "rate_messages" in done.columns
    assert (tmp_path / "out/01-write/output/_SUCCESS").stat().st_mtime == stamp
    assert spark.read.parquet(f"file://{tmp_path}/out/final").count() == 4 and (tmp_path / "out/pipeline.json").exists()
    again = run_pipeline(spark, two_steps(tmp_path, overwrite=True), ["rate"])
    assert sorted(again.collect()) == sorted(rows) and (tmp_path / "out/01-write/output/_SUCCESS").stat().st_mtime == stamp


def test_a_generate_pipeline(spark, tmp_path):
    config = PipelineConfig(f"file://{tmp_path}/out", [{"name": "make", "type": "generate", "prompts": ["fact"], "num_samples": 3}, {"name": "rate", "prompt": "Rate {make_response}"}], client={"provider": "echo"})
    assert sorted(r.rate_response for r in run_pipeline(spark, config).collect()) == ["Rate fact"] * 3


def test_command_line(tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps({"output_dir": "out", "dataset": {"path": "d"}, "client": {"model": "m", "engine": {"max_model_len": 8}}, "steps": [step("a")]}))
    assert main([str(tmp_path / "c.json"), "--describe-steps"]) == 0
    assert json.loads(capsys.readouterr().out)["kind"] == "vllm_offline"
    assert main([str(tmp_path / "c.json"), "--serve-args", "a"]) == 0
    assert capsys.readouterr().out.strip() == "--tensor-parallel-size 1 --max-model-len 8"
    with pytest.raises(ValueError):
        serve_args(PipelineConfig("o", [step("a")], DatasetConfig(path="p"), {"provider": "echo"}), "a")


def test_logging():
    assert level_of("debug") == 10 and level_of(30) == 30 and configure("WARNING").level == 30
    assert get_logger("x").name == "millrace.x"
    with pytest.raises(ValueError):
        level_of("loud")


def test_public_names():
    import millrace

    assert all(getattr(millrace, name) is not None for name in millrace.__all__)
    with pytest.raises(AttributeError):
        millrace.nope


@pytest.mark.parametrize(
    "data, text",
    [
        (["a ", {"name": "b", "detail": " d "}, {"persona": "c"}, {"label": "e", "description": ""}, {"detail": "no code"}, 7], "- `a`\n- `b` — d\n- `c`\n- `e`"),
        ({"instruction": " Pick: ", "other": ["z"], "items": [{"code": "x", "name": "n", "description": "the x"}]}, "Pick:\n- `x` — the x"),
        ({"instruction": 5, "other": ["z"]}, "- `z`"),
        ({"instruction": "Only this"}, "Only this"),
    ],
)
def test_catalogue_forms(data, text):
    assert catalog_text(data) == text


@pytest.mark.parametrize("bad", [5, {"items": "x"}, [], [{"detail": "x"}]])
def test_bad_catalogues(bad):
    with pytest.raises(ValueError):
        catalog_text(bad)


def test_dataset_configurations_are_folders(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k}", "ab"[k % 2], "train") for k in range(6)], "k long, text string, config string, split string")
    rows.write.partitionBy("config", "split").parquet(f"file://{tmp_path}/data")
    make = lambda out, **more: PipelineConfig(f"file://{tmp_path}/{out}", [step("one", sort_by_length=True, max_samples_per_output_file=1)], {"path": f"file://{tmp_path}/data", **more}, {"provider": "echo", "num_proc": 2})
    assert sorted(r.text for r in run_pipeline(spark, make("x", config="b", split="train")).collect()) == ["t1", "t3", "t5"]
    with pytest.raises(ValueError, match="several values of config"):
        run_pipeline(spark, make("y"))
    with pytest.raises(ValueError, match="no config 'c'"):
        run_pipeline(spark, make("z", config="c"))
