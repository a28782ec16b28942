"""Millrace: a Spark-native engine for resumable dataset annotation."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

#: Public names and the modules that they are loaded from at first use.
_PUBLIC = {
    "millrace.config": ["ClientConfig", "DatasetConfig", "EngineConfig", "PipelineConfig", "StepConfig", "load_file", "load_pipeline"],
    "millrace.functions.properties": ["property_messages", "property_schema"],
    "millrace.functions.schemas": ["close_objects", "inline_definitions", "spark_type"],
    "millrace.logs": ["configure", "get_logger", "level_of"],
    "millrace.operators.annotate": ["AnnotateSpec", "annotate"],
    "millrace.operators.progress": ["Progress", "import_jsonl", "run_annotation"],
    "millrace.pipeline": ["run_pipeline"],
    "millrace.plans.annotator": ["annotate_dataset", "generate_dataset"],
    "millrace.plans.prepare": ["PrepareSpec", "prepare", "prepare_data"],
    "millrace.plans.template": ["PromptTemplate", "TemplateError"],
    "millrace.providers": ["ClientError", "ConfigurationError", "ParsingError", "Provider", "ProviderError", "ProviderSpec", "Response", "RuntimeOptions", "halving"],
    "millrace.providers.http": ["ClaudeOptions", "ClaudeProvider", "OpenAIOptions", "OpenAIProvider", "VLLMOptions", "VLLMProvider"],
    "millrace.providers.local": ["EchoProvider", "VLLMOfflineOptions", "VLLMOfflineProvider"],
    "millrace.streaming.resume": ["annotate_stream", "read_stream_results"],
}
_WHERE = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module 'millrace' has no attribute {name!r}")
    return getattr(importlib.import_module(_WHERE[name]), name)
