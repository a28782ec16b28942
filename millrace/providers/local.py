"""Providers that run in the worker: deterministic ones for tests, and an in-process engine."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from .base import ConfigurationError, Messages, Provider, ProviderError, Response, RuntimeOptions, halving


class EchoProvider(Provider):
    """Answers with the last message; with a schema, every property is 4 for integers, else ``name::message``."""

    name = "echo"

    def generate(self, messages: Messages, options: RuntimeOptions, **extra: Any) -> Response:
        said = messages[-1]["content"]
        if options.json_schema:
            properties = options.json_schema.get("properties", {})
            said = json.dumps({k: 4 if v.get("type") == "integer" else f"{k}::{said}" for k, v in properties.items()}, ensure_ascii=False)
        return Response(said, "stop", self.model or "echo", self.name, 3)


class ScriptedProvider(Provider):
    """Fails as told by the message: ``fail:<n>`` gives bad JSON n times, ``error`` an error row, ``length`` a cut answer.

    Otherwise it answers ``{"label": <message>}``. Attempts are counted by message, in this worker.
    """

    name = "scripted"

    def __init__(self, model: str = "", **kwargs: Any):
        super().__init__(model, **{"on_error": "ignore", **kwargs})
        self.attempts: dict[str, int] = {}

    def finished(self, reason: str | None) -> bool:
        return reason == "stop"

    def generate(self, messages: Messages, options: RuntimeOptions, **extra: Any) -> Response:
        said = messages[-1]["content"]
        self.attempts[said] = self.attempts.get(said, 0) + 1
        if said.startswith("error"):
            raise ProviderError("scripted failure")
        word, _, n = said.partition(" ")[0].partition(":")
        if word == "fail" and self.attempts[said] <= int(n):
            return Response("not json", "stop", self.model, self.name, 2)
        text = json.dumps({"label": said, "attempt": self.attempts[said]}, ensure_ascii=False)
        return Response(text, "length" if said.startswith("length") else "stop", self.model, self.name, 5)


@dataclass(frozen=True)
class VLLMOfflineOptions(RuntimeOptions):
    temperature: float | None = None
    top_p: float | None = None
    top_k: int | None = None
    min_p: float | None = None
    seed: int | None = None
    stop: list[str] | None = None
    presence_penalty: float | None = None
    frequency_penalty: float | None = None
    repetition_penalty: float | None = None


class VLLMOfflineProvider(Provider):
    """An engine in the worker's process, loaded at first use. ``engine`` may be given for tests.

    An engine has ``chat(batch, **parameters)`` that returns (text, stop reason, tokens) of
    each conversation. Batches that run out of memory are halved before the error policy applies.
    """

    holds_engine = True
    name = "vllm_offline"
    options_class = VLLMOfflineOptions

    def __init__(self, model: str, engine: Any = None, least_batch: int = 1, on_error: str = "warn", **settings: Any):
        super().__init__(model, None, on_error)
        self._engine, self._least, self._settings = engine, least_batch, settings

    @property
    def engine(self) -> Any:
        if self._engine is None:
            try:
                import vllm
            except ImportError as e:
                raise ConfigurationError("provider vllm_offline needs the vllm package on the workers") from e
            self._engine = _Engine(vllm, self.model, self._settings)
        return self._engine

    def finished(self, reason: str | None) -> bool:
        return reason in (None, "stop")

    def generate(self, messages: Messages, options: RuntimeOptions, **extra: Any) -> Response:
        return self._run([messages], options, extra)[0]

    def _run(self, batch: Sequence[Messages], options: RuntimeOptions, extra: dict) -> list[Response]:
        return [Response(t, r, self.model, self.name, n) for t, r, n in self.engine.chat(list(batch), json_schema=options.json_schema, **{**options.to_payload(), **extra})]

    def batch(self, batch: Sequence[Messages], options: RuntimeOptions, **extra: Any) -> list[Response]:
        out_of_memory = lambda e: isinstance(e, MemoryError) or "out of memory" in str(e).lower()
        try:
            return [self.checked(r) for r in halving(lambda part: self._run(part, options, extra), out_of_memory, self._least)(list(batch))]
        except ConfigurationError:
            raise
        except Exception as e:  # noqa: BLE001
            return [self.failed(e) for _ in batch]

    def warm_up(self, prefix: str, system: str | None, options: RuntimeOptions) -> None:
        first = [{"role": "system", "content": system}] if system else []
        self.engine.chat([[*first, {"role": "user", "content": prefix}]], max_completion_tokens=1)

    def close(self) -> None:
        self._engine = None


class _Engine:
    def __init__(self, vllm: Any, model: str, settings: dict):
        self.vllm, self.llm = vllm, vllm.LLM(model=model, **settings)

    def chat(self, batch: list[Messages], json_schema: dict | None = None, max_completion_tokens: int | None = None, **parameters: Any) -> list[tuple[str, str | None, int]]:
        if json_schema:
            parameters["structured_outputs"] = self.vllm.sampling_params.StructuredOutputsParams(json=json_schema)
        sampling = self.vllm.SamplingParams(max_tokens=max_completion_tokens, **parameters)
        return [(o.outputs[0].text, o.outputs[0].finish_reason, len(o.outputs[0].token_ids)) for o in self.llm.chat(batch, sampling)]
