"""Providers behind HTTP, with the standard library's client."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from millrace.functions.schemas import close_objects, drop_integer_bounds

from .base import ConfigurationError, Messages, Provider, ProviderError, Response, RuntimeOptions, UnavailableError


def post(url: str, body: dict | bytes | None, headers: dict[str, str], timeout: float = 600.0, method: str | None = None) -> Any:
    """JSON of a reply; what the server says on failure is in the error."""
    data = body if isinstance(body, bytes) or body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", **headers}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.loads(reply.read() or b"null")
    except urllib.error.HTTPError as e:
        kind = UnavailableError if e.code in (502, 503, 504) else ProviderError
        raise kind(f"HTTP {e.code}: {e.read(500).decode(errors='replace')}") from e
    except (urllib.error.URLError, OSError) as e:
        raise UnavailableError(str(e)) from e
    except ValueError as e:
        raise ProviderError(str(e)) from e


def wait_for_servers(urls: Sequence[str], timeout: float, every: float = 5.0) -> None:
    """Return once each server's ``/health`` answers; ``TimeoutError`` after so many seconds for one."""
    for url in urls:
        until = time.monotonic() + timeout
        while True:
            try:
                with urllib.request.urlopen(f"{url.removesuffix('/v1').rstrip('/')}/health", timeout=5) as reply:
                    if reply.status == 200:
                        break
            except OSError:
                pass
            if time.monotonic() > until:
                raise TimeoutError(f"no answer from {url} in {timeout:g} s")
            time.sleep(every)


def split_system(messages: Messages) -> tuple[Messages, str | None]:
    """Other messages and the system text, which must be single and first."""
    at = [k for k, m in enumerate(messages) if m["role"] == "system"]
    if at and at != [0]:
        raise ConfigurationError("a system message must be the only one and come first")
    return [m for m in messages if m["role"] != "system"], messages[0]["content"] if at else None


@dataclass(frozen=True)
class OpenAIOptions(RuntimeOptions):
    temperature: float | None = None
    top_p: float | None = None
    seed: int | None = None
    stop: list[str] | None = None
    presence_penalty: float | None = None
    frequency_penalty: float | None = None
    reasoning_effort: str | None = None
    batch_api: bool = False
    poll_seconds: float = 30.0

    def to_payload(self) -> dict[str, Any]:
        return {k: v for k, v in super().to_payload().items() if k not in ("batch_api", "poll_seconds")}


class OpenAIProvider(Provider):
    name = "openai"
    options_class = OpenAIOptions
    #: Variable that the key is read from where none is given.
    key_variable = "OPENAI_API_KEY"

    def __init__(self, model: str | None, base_url: str = "https://api.openai.com/v1", api_key: str | None = None, max_workers: int | None = 8, on_error: str = "warn", timeout: float = 600.0):
        super().__init__(model or "", max_workers, on_error)
        self.base_url, self.timeout = base_url.rstrip("/"), timeout
        self.headers = {"Authorization": f"Bearer {api_key or os.environ.get(self.key_variable, '')}"}

    def finished(self, reason: str | None) -> bool:
        return reason == "stop"

    def payload(self, messages: Messages, options: RuntimeOptions, extra: dict) -> dict:
        """Body of a request; what ``extra`` names wins."""
        body = {"model": self.model, "messages": messages, **options.to_payload()}
        if options.json_schema:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "answer", "strict": True, "schema": close_objects(options.json_schema)}}
        return {**body, **extra}

    def response(self, reply: dict, choice: int = 0) -> Response:
        try:
            one = reply["choices"][choice]
            text = one["message"].get("content") or ""
        except (KeyError, IndexError, TypeError) as e:
            raise ProviderError(f"reply without an answer: {str(reply)[:200]}") from e
        used = reply.get("usage") or {}
        return Response(text, one.get("finish_reason"), reply.get("model") or self.model, self.name, used.get("completion_tokens") if len(reply["choices"]) == 1 else None)

    def generate(self, messages: Messages, options: RuntimeOptions, **extra: Any) -> Response:
        return self.response(post(f"{self.base_url}/chat/completions", self.payload(messages, options, extra), self.headers, self.timeout))

    def batch(self, batch: Sequence[Messages], options: RuntimeOptions, **extra: Any) -> list[Response]:
        if not getattr(options, "batch_api", False):
            return super().batch(batch, options, **extra)
        try:
            return self._batch_job(batch, options, extra)
        except ProviderError as e:
            return [self.failed(e) for _ in batch]

    def _batch_job(self, batch: Sequence[Messages], options: OpenAIOptions, extra: dict) -> list[Response]:
        """Submit a job, wait for its end, and put its results in order."""
        name = self.submit(batch, options, extra, uuid.uuid4().hex)
        while not self.job_ended(name):
            time.sleep(options.poll_seconds)
        return self.job_results(name, len(batch))

    def submit(self, batch: Sequence[Messages], options: OpenAIOptions, extra: dict, key: str, look: bool = False) -> str:
        """Name of the job that answers a batch. With ``look`` a job of the same key that is there already is taken."""
        if look and (found := self._job_of(key)):
            return found
        lines = [{"custom_id": str(k), "method": "POST", "url": "/v1/chat/completions", "body": self.payload(m, options, extra)} for k, m in enumerate(batch)]
        edge = uuid.uuid4().hex
        part = f'--{edge}\r\nContent-Disposition: form-data; name="purpose"\r\n\r\nbatch\r\n--{edge}\r\nContent-Disposition: form-data; name="file"; filename="requests.jsonl"\r\n\r\n'
        body = part.encode() + "\n".join(map(json.dumps, lines)).encode() + f"\r\n--{edge}--\r\n".encode()
        sent = post(f"{self.base_url}/files", body, {**self.headers, "Content-Type": f"multipart/form-data; boundary={edge}"}, self.timeout)
        made = {"input_file_id": sent["id"], "endpoint": "/v1/chat/completions", "completion_window": "24h", "metadata": {"key": key}}
        return post(f"{self.base_url}/batches", made, self.headers, self.timeout)["id"]

    def _job_of(self, key: str) -> str | None:
        after = ""
        while True:
            page = post(f"{self.base_url}/batches?limit=100{after}", None, self.headers, self.timeout)
            for job in page.get("data", ()):
                if (job.get("metadata") or {}).get("key") == key and job["status"] not in ("failed", "cancelled", "expired"):
                    return job["id"]
            if not page.get("has_more") or not page.get("data"):
                return None
            after = f"&after={page['data'][-1]['id']}"

    def _job(self, name: str) -> dict:
        return post(f"{self.base_url}/batches/{name}", None, self.headers, self.timeout)

    def job_ended(self, name: str) -> bool:
        return self._job(name)["status"] in ("completed", "failed", "expired", "cancelled")

    def job_results(self, name: str, n: int) -> list[Response]:
        """Responses of a job that ended, in the order of its batch; what has no result is an error."""
        job, found = self._job(name), {}
        for file in filter(None, (job.get("output_file_id"), job.get("error_file_id"))):
            request = urllib.request.Request(f"{self.base_url}/files/{file}/content", headers=self.headers)
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                for line in filter(bytes.strip, reply.read().splitlines()):
                    item = json.loads(line)
                    body = (item.get("response") or {}).get("body") or {}
                    trouble = item.get("error") or body.get("error")
                    at = int(item["custom_id"])
                    found[at] = self.failed(ProviderError(str(trouble))) if trouble else self.checked(self.response(body))
        return [found.get(k) or self.failed(ProviderError(f"batch {job['status']}: no result")) for k in range(n)]


@dataclass(frozen=True)
class ClaudeOptions(RuntimeOptions):
    temperature: float | None = None
    top_p: float | None = None
    top_k: int | None = None
    stop_sequences: list[str] | None = None

    def to_payload(self) -> dict[str, Any]:
        body = super().to_payload()
        return {"max_tokens": body.pop("max_completion_tokens", 1024), **body}


class ClaudeProvider(Provider):
    name = "claude"
    options_class = ClaudeOptions

    def __init__(self, model: str, base_url: str = "https://api.anthropic.com/v1", api_key: str | None = None, max_workers: int | None = 4, on_error: str = "warn", timeout: float = 600.0):
        super().__init__(model, max_workers, on_error)
        self.base_url, self.timeout = base_url.rstrip("/"), timeout
        self.headers = {"x-api-key": api_key or os.environ.get("ANTHROPIC_API_KEY", ""), "anthropic-version": "2023-06-01"}

    def finished(self, reason: str | None) -> bool:
        return reason in (None, "end_turn", "stop_sequence")

    def payload(self, messages: Messages, options: RuntimeOptions, extra: dict) -> dict:
        rest, system = split_system(messages)
        body = {"model": self.model, "messages": rest, **options.to_payload()}
        if system is not None:
            body["system"] = system
        if options.json_schema:
            body["output_config"] = {"format": {"type": "json_schema", "schema": close_objects(drop_integer_bounds(options.json_schema))}}
        return {**body, **extra}

    def generate(self, messages: Messages, options: RuntimeOptions, **extra: Any) -> Response:
        reply = post(f"{self.base_url}/messages", self.payload(messages, options, extra), self.headers, self.timeout)
        text = "\n".join(b.get("text", "") for b in reply.get("content", ()) if b.get("type") == "text").strip()
        return Response(text, reply.get("stop_reason"), reply.get("model") or self.model, self.name, (reply.get("usage") or {}).get("output_tokens"))


@dataclass(frozen=True)
class VLLMOptions(OpenAIOptions):
    top_k: int | None = None
    min_p: float | None = None
    repetition_penalty: float | None = None
    enable_thinking: bool | None = None

    def to_payload(self) -> dict[str, Any]:
        body = super().to_payload()
        thinking = body.pop("enable_thinking", None)
        return body if thinking is None else {**body, "chat_template_kwargs": {"enable_thinking": thinking}}


class VLLMProvider(OpenAIProvider):
    """A served engine: one request for the conversations of a batch."""

    name = "vllm_online"
    options_class = VLLMOptions
    key_variable = "VLLM_API_KEY"

    def __init__(self, model: str | None = None, base_url: str = "http://localhost:8000/v1", **kwargs: Any):
        super().__init__(model, base_url, **kwargs)
        if not self.model:
            self.model = post(f"{self.base_url}/models", None, self.headers, self.timeout)["data"][0]["id"]

    def batch(self, batch: Sequence[Messages], options: RuntimeOptions, **extra: Any) -> list[Response]:
        if not batch:
            return []
        try:
            body = self.payload([], options, extra) | {"messages": list(batch)}
            reply = post(f"{self.base_url}/chat/completions/batch", body, self.headers, self.timeout)
            found = [self.checked(self.response(reply, k)) for k in range(len(reply["choices"]))]
        except (ProviderError, KeyError, TypeError) as e:
            return [self.failed(e) for _ in batch]
        # Too few answers become error rows; too many are for the operator to refuse.
        return found + [self.failed(ProviderError("the server gave no answer")) for _ in range(len(batch) - len(found))]
