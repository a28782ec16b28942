import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from millrace.providers import ConfigurationError, ProviderError, ProviderSpec, RuntimeOptions, halving
from millrace.providers.http import ClaudeOptions, ClaudeProvider, OpenAIOptions, OpenAIProvider, VLLMOptions, VLLMProvider, split_system, wait_for_servers
from millrace.providers.local import VLLMOfflineProvider
from millrace.queries import FailingProvider

USER = [{"role": "user", "content": "hi"}]


def choice(text, reason="stop"):
    return {"message": {"content": text}, "finish_reason": reason}


class Handler(BaseHTTPRequestHandler):
    seen: list = []
    batch_lines: list = []

    def log_message(self, *_):
        pass

    def reply(self, body, code=200, raw=False):
        data = body if raw else json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        if self.path.endswith("/models"):
            self.reply({"data": [{"id": "served"}]})
        elif self.path.endswith("/health"):
            self.reply({})
        elif self.path.endswith("/batches/j"):
            self.reply({"id": "j", "status": "completed", "output_file_id": "o"})
        else:
            self.reply("\n".join(map(json.dumps, self.batch_lines)).encode(), raw=True)

    def do_POST(self):
        raw = self.rfile.read(int(self.headers["Content-Length"]))
        if self.path.endswith("/files"):
            return self.reply({"id": "f"})
        body = json.loads(raw)
        self.seen.append((self.path, body))
        if self.path.endswith("/batches"):
            return self.reply({"id": "j", "status": "in_progress"})
        if self.path.endswith("/completions/batch"):
            return self.reply({"choices": [choice(m[-1]["content"]) for m in body["messages"]][:2]})
        if self.path.endswith("/messages"):
            return self.reply({"content": [{"type": "text", "text": " a"}, {"type": "x"}, {"type": "text", "text": "b "}], "stop_reason": "end_turn", "usage": {"output_tokens": 7}})
        said = body["messages"][-1]["content"]
        if said == "broken":
            return self.reply({"error": "no"}, 500)
        return self.reply({"choices": [choice(said, "length" if said == "long" else "stop")], "usage": {"completion_tokens": 3}, "model": "m1"})


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def test_openai_batches_keep_order_and_single_errors(url):
    p = OpenAIProvider("m", url, "k", on_error="ignore")
    said = ["a", "broken", "long", "b"]
    got = p.batch([[{"role": "user", "content": s}] for s in said], OpenAIOptions(temperature=0.0, max_completion_tokens=9, json_schema={"type": "object"}), seed=5)
    assert [r.text for r in got] == ["a", "", "long", "b"] and [r.error_type for r in got] == [None, "ProviderError", "ProviderError", None]
    assert "HTTP 500" in got[1].error and got[2].num_output_tokens == 3 and got[0].model == "m1"
    body = next(b for _, b in Handler.seen if b.get("messages") == [{"role": "user", "content": "a"}])
    assert body["temperature"] == 0.0 and body["seed"] == 5 and body["response_format"]["json_schema"]["schema"]["additionalProperties"] is False and "top_p" not in body
    with pytest.raises(ProviderError):
        OpenAIProvider("m", url, "k", on_error="raise").batch([[{"role": "user", "content": "broken"}]], OpenAIOptions())


def test_openai_batch_jobs_are_put_in_order(url):
    ok = lambda k: {"custom_id": k, "response": {"body": {"choices": [choice(f"r{k}")]}}}
    Handler.batch_lines = [ok("2"), {"custom_id": "0", "error": {"message": "bad"}}]
    got = OpenAIProvider("m", url, "k", on_error="ignore").batch([USER] * 3, OpenAIOptions(batch_api=True, poll_seconds=0.01))
    assert [r.text for r in got] == ["", "", "r2"] and [bool(r.error) for r in got] == [True, True, False]


def test_claude(url):
    p = ClaudeProvider("m", url, "k")
    r = p.answer([{"role": "system", "content": "s"}, *USER], ClaudeOptions(json_schema={"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}}}))
    assert (r.text, r.num_output_tokens, r.error) == ("a\nb", 7, None)
    body = Handler.seen[-1][1]
    assert body["system"] == "s" and body["messages"] == USER and body["max_tokens"] == 1024 and "minimum" not in json.dumps(body)
    with pytest.raises(ConfigurationError):
        split_system([*USER, {"role": "system", "content": "s"}])


def test_vllm_pads_and_finds_its_model(url):
    p = VLLMProvider(base_url=url, on_error="ignore")
    assert p.model == "served"
    got = p.batch([USER] * 3, VLLMOptions(enable_thinking=False))
    assert [r.text for r in got] == ["hi", "hi", ""] and got[2].error and got[0].num_output_tokens is None
    assert Handler.seen[-1][1]["chat_template_kwargs"] == {"enable_thinking": False}
    assert p.batch([], VLLMOptions()) == []
    wait_for_servers([url], 1)
    with pytest.raises(TimeoutError):
        wait_for_servers(["http://127.0.0.1:9/v1"], 0.05, 0.01)


class Engine:
    def __init__(self, most):
        self.most, self.sizes = most, []

    def chat(self, batch, **parameters):
        self.sizes.append(len(batch))
        if len(batch) > self.most:
            raise RuntimeError("CUDA out of memory")
        return [(m[-1]["content"], "stop", 1) for m in batch]


def test_memory_is_halved_under_every_policy():
    for policy in ("raise", "ignore"):
        engine = Engine(2)
        p = VLLMOfflineProvider("m", engine, on_error=policy)
        assert [r.text for r in p.batch([[{"role": "user", "content": str(k)}] for k in range(7)], RuntimeOptions())] == [str(k) for k in range(7)]
        assert engine.sizes == [7, 3, 1, 1, 1, 1, 1, 1, 1]
    assert VLLMOfflineProvider("m", Engine(0), on_error="ignore").batch([USER], RuntimeOptions())[0].error
    with pytest.raises(ValueError):
        halving(lambda x: 1 / 0 if not x else (_ for _ in ()).throw(ValueError("other")), lambda e: False)([1, 2])


def test_policies_and_specs():
    assert FailingProvider().answer([{"role": "user", "content": "2"}], RuntimeOptions()).error == "even"
    cut = FailingProvider().answer([{"role": "user", "content": "3"}], RuntimeOptions())
    assert cut.text == "3" and cut.stop_reason == "length" and cut.error_type == "ProviderError"
    with pytest.raises(ValueError):
        FailingProvider(on_error="never")
    with pytest.raises(ConfigurationError):
        ProviderSpec("nope").build()
    with pytest.raises(ConfigurationError):
        ProviderSpec("echo", options={"nope": 1}).runtime_options(ProviderSpec("echo").build(), None)
    with FailingProvider() as p:
        assert p.name == "failing"
