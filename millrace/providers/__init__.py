"""Providers by name."""

from __future__ import annotations

from collections.abc import Callable

from .base import (
    ClientError,
    ConfigurationError,
    Messages,
    OnError,
    ParsingError,
    Provider,
    ProviderError,
    ProviderSpec,
    Response,
    RuntimeOptions,
    UnavailableError,
    halving,
)

__all__ = ["ClientError", "ConfigurationError", "Messages", "OnError", "ParsingError", "Provider", "ProviderError", "ProviderSpec", "Response", "RuntimeOptions", "UnavailableError", "by_name", "halving"]

#: Names of the hosted and served providers as configurations spell them.
NAMES = ("openai", "claude", "vllm_online", "vllm_offline")


def by_name(name: str) -> Callable[..., Provider]:
    from . import http, local

    known = {"openai": http.OpenAIProvider, "claude": http.ClaudeProvider, "vllm_online": http.VLLMProvider, "vllm_offline": local.VLLMOfflineProvider, "echo": local.EchoProvider, "scripted": local.ScriptedProvider}
    if name not in known:
        raise ConfigurationError(f"unknown provider {name!r}; choose one of {sorted(known)}")
    return known[name]
