"""Provider interface: what answers a batch of conversations inside a worker."""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod
from collections import OrderedDict
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields, replace
from functools import partial
from typing import Any, Literal

log = logging.getLogger("millrace.providers")
Messages = list[dict[str, str]]
OnError = Literal["raise", "ignore", "warn"]


class ClientError(Exception):
    """Base of all provider trouble."""


class ConfigurationError(ClientError):
    """A provider was set up wrongly."""


class ProviderError(ClientError):
    """A provider failed or did not finish an answer."""


class UnavailableError(ProviderError):
    """A server could not be reached."""


class ParsingError(ClientError):
    """An answer could not be read."""


@dataclass(frozen=True)
class Response:
    text: str
    stop_reason: str | None = None
    model: str | None = None
    provider: str | None = None
    num_output_tokens: int | None = None
    error: str | None = None
    error_type: str | None = None


@dataclass(frozen=True)
class RuntimeOptions:
    """Options of a request that all providers share."""

    max_completion_tokens: int | None = None
    json_schema: dict | None = None

    def to_payload(self) -> dict[str, Any]:
        """Request parameters; what is not set is left out."""
        return {f.name: v for f in fields(self) if f.name != "json_schema" and (v := getattr(self, f.name)) is not None}


class Provider(ABC):
    """Answers conversations. Built in the worker from a spec, so it may hold connections."""

    name: str = "provider"
    #: Whether it fills the memory of a device, so that a worker keeps one of its kind.
    holds_engine = False
    options_class: type[RuntimeOptions] = RuntimeOptions

    def __init__(self, model: str, max_workers: int | None = None, on_error: OnError = "warn"):
        if on_error not in ("raise", "ignore", "warn"):
            raise ValueError("on_error must be raise, ignore or warn")
        self.model, self.max_workers, self.on_error = model, max_workers, on_error
        #: Whether an unreachable server is an error under any policy, so that a pool can ask another one.
        self.raise_unavailable = False

    @abstractmethod
    def generate(self, messages: Messages, options: RuntimeOptions, **extra: Any) -> Response:
        """Answer one conversation; raises ``ProviderError`` where it cannot."""

    def answer(self, messages: Messages, options: RuntimeOptions, **extra: Any) -> Response:
        """``generate`` under the error policy."""
        try:
            return self.checked(self.generate(messages, options, **extra))
        except Exception as e:  # noqa: BLE001
            return self.failed(e)

    def batch(self, batch: Sequence[Messages], options: RuntimeOptions, **extra: Any) -> list[Response]:
        """One response for each conversation, in order; failures are single rows."""
        workers = min(self.max_workers or 1, len(batch))
        if workers <= 1:
            return [self.answer(m, options, **extra) for m in batch]
        with ThreadPoolExecutor(workers) as pool:
            return list(pool.map(lambda m: self.answer(m, options, **extra), batch))

    def finished(self, reason: str | None) -> bool:
        """Whether a stop reason means a whole answer."""
        return True

    def checked(self, r: Response) -> Response:
        """The response, or an error row that keeps its text if it did not finish."""
        if r.error is None and not self.finished(r.stop_reason):
            return self.failed(ProviderError(f"generation stopped: {r.stop_reason}"), partial=r)
        return r

    def failed(self, e: Exception, partial: Response | None = None) -> Response:
        """Raise, or make an error row that keeps what there is of an answer."""
        known = e if isinstance(e, ClientError) else ProviderError(f"{type(e).__name__}: {e}")
        if self.on_error == "raise" or (self.raise_unavailable and isinstance(known, UnavailableError)):
            raise known from e
        if self.on_error == "warn":
            log.warning("%s: %s", self.name, known)
        start = partial or Response("", None, self.model, self.name)
        return replace(start, model=start.model or self.model, provider=start.provider or self.name, error=str(known), error_type=type(known).__name__)

    def warm_up(self, prefix: str, system: str | None, options: RuntimeOptions) -> None:
        """Prime caches with what all prompts share."""

    def close(self) -> None:
        """Release connections."""

    def __enter__(self) -> Provider:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class Keeper:
    """Providers that a worker keeps for later tasks and steps, by their key; the least recently used goes beyond ``most``.

    Of those that hold an engine one is kept at a time, as engines fill the memory of their
    device. What a worker still holds when its process ends is closed with it.
    """

    def __init__(self, most: int = 8):
        self.most, self.kept = most, OrderedDict()

    def get(self, key: str, make: Callable[[], Provider], engine: bool) -> Provider:
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        gone = [k for k, p in self.kept.items() if engine and p.holds_engine]
        if len(self.kept) - len(gone) >= self.most:
            gone += [k for k in self.kept if k not in gone][:1]
        for k in gone:
            self.kept.pop(k).close()
        self.kept[key] = make()
        return self.kept[key]


KEEPER = Keeper()


@dataclass(frozen=True)
class ProviderSpec:
    """Everything to build a provider in a worker. ``factory`` is a name known to ``providers`` or a callable."""

    factory: str | Callable[..., Provider]
    model: str = ""
    init: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    extra: dict = field(default_factory=dict)
    #: Servers, each given as ``base_url``; several form a pool in each task.
    base_urls: tuple[str, ...] = ()
    #: Name under which a worker keeps the provider for later tasks and steps.
    reuse: str = ""

    @property
    def shared(self) -> bool:
        return bool(self.reuse) and len(self.base_urls) < 2

    def build(self, partition: int = 0) -> Provider:
        make = self.makers(partition)[0]
        return KEEPER.get(self.reuse, make, self._factory().holds_engine) if self.shared else make()

    def _factory(self) -> Any:
        from millrace import providers

        made = providers.by_name(self.factory) if isinstance(self.factory, str) else self.factory
        return made if isinstance(made, type) else Provider

    def makers(self, partition: int = 0) -> list[Callable[[], Provider]]:
        """What makes a client for each server, beginning with the partition's own."""
        from millrace import providers
        from millrace.providers.pool import first_server

        make = providers.by_name(self.factory) if isinstance(self.factory, str) else self.factory
        if not self.base_urls:
            return [partial(make, model=self.model, **self.init)]
        first = first_server(partition, len(self.base_urls))
        return [partial(make, model=self.model, **self.init, base_url=url) for url in (*self.base_urls[first:], *self.base_urls[:first])]

    def runtime_options(self, provider: Provider, schema: dict | None) -> RuntimeOptions:
        unknown = set(self.options) - {f.name for f in fields(provider.options_class)}
        if unknown:
            raise ConfigurationError(f"unknown options {sorted(unknown)} for {provider.name}")
        return provider.options_class(**{**self.options, **({"json_schema": schema} if schema else {})})


def halving(run: Callable[[list], list], is_oom: Callable[[Exception], bool], least: int = 1) -> Callable[[list], list]:
    """``run`` that answers a batch in halves, quarters... when memory runs out, down to ``least`` items."""

    def attempt(items: list) -> list:
        size = max(least, len(items))
        done: list = []
        while len(done) < len(items):
            try:
                done += run(items[len(done) : len(done) + size])
            except Exception as e:
                if not is_oom(e) or size <= least:
                    raise
                size = max(least, size // 2)
        return done

    return attempt
