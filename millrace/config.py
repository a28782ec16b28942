"""Pipeline configurations: strict dataclasses read from JSON or YAML."""

from __future__ import annotations

import glob
import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from millrace.functions.schemas import as_schema
from millrace.providers import NAMES, ProviderSpec, by_name

#: Keys of a client block that are merged key by key rather than replaced.
MERGED = ("init", "options", "engine", "pool", "gen_kwargs")
POOL_KEYS = ("base_urls", "hosts_file", "url_glob")
#: Keys of a catalogue's list in order of preference, and of an entry's code and description.
CATALOG_LISTS = ("professional", "profession", "social", "categories", "personas", "items", "codes")
CATALOG_CODES = ("code", "name", "persona", "label")
CATALOG_DETAILS = ("description", "detail")


def strict(cls: type, data: Any, where: str) -> Any:
    """An instance of a dataclass from a mapping; unknown keys are errors."""
    if not isinstance(data, dict):
        raise ValueError(f"{where} must be a mapping, not {type(data).__name__}")
    unknown = sorted(set(data) - {f.name for f in fields(cls) if f.init})
    if unknown:
        raise ValueError(f"{where}: unknown keys {unknown}")
    return cls(**data)


def _path(path: str, root: Path) -> Path:
    p = Path(path).expanduser()
    return p if p.is_absolute() else root / p


@dataclass(frozen=True)
class DatasetConfig:
    """Source of the first step: a table or format by name, or a folder."""

    name: str | None = None
    path: str | None = None
    config: str | None = None
    split: str | None = None
    data_dir: str | None = None
    max_num_samples: int | None = None
    shuffle_seed: int | None = None

    def __post_init__(self) -> None:
        if (self.name is None) == (self.path is None):
            raise ValueError("dataset: give exactly one of name and path")


@dataclass(frozen=True)
class EngineConfig:
    """How one engine is built, loaded in a worker or served."""

    tensor_parallel_size: int = 1
    max_model_len: int | None = None
    gpu_memory_utilization: float | None = None
    max_num_seqs: int | None = None
    max_num_batched_tokens: int | None = None
    enforce_eager: bool | None = None
    quantization: str | None = None
    enable_prefix_caching: bool | None = None
    enable_chunked_prefill: bool | None = None
    speculative_config: dict | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.tensor_parallel_size < 1:
            raise ValueError("engine: tensor_parallel_size must be 1 or more")

    def settings(self) -> dict[str, Any]:
        """What is set, with ``extra`` over it."""
        return {k: v for k, v in asdict(self).items() if k != "extra" and v is not None} | self.extra

    def serve_args(self) -> list[str]:
        """Flags for a server: booleans as --x or --no-x, mappings and lists as compact JSON."""
        out: list[str] = []
        for name, value in self.settings().items():
            flag = name.replace("_", "-")
            if isinstance(value, bool):
                out.append(f"--{flag}" if value else f"--no-{flag}")
            else:
                out += [f"--{flag}", json.dumps(value, separators=(",", ":")) if isinstance(value, (dict, list)) else str(value)]
        return out


@dataclass(frozen=True)
class PoolConfig:
    servers: int = 1

    def __post_init__(self) -> None:
        if self.servers < 1:
            raise ValueError("pool: servers must be 1 or more")


@dataclass(frozen=True)
class ClientConfig:
    """Provider, model and how they are run."""

    provider: str = "vllm_offline"
    model: str | None = None
    init: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    batch_size: int = 256
    num_proc: int | None = None
    base_urls: list = field(default_factory=list)
    hosts_file: str | None = None
    url_glob: str | None = None
    queue_size: int | None = None
    wait_for_servers: float = 60.0
    engine: EngineConfig = field(default_factory=EngineConfig)
    pool: PoolConfig = field(default_factory=PoolConfig)
    gen_kwargs: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, cls in (("engine", EngineConfig), ("pool", PoolConfig)):
            if isinstance(value := getattr(self, name), dict):
                object.__setattr__(self, name, strict(cls, value, f"client.{name}"))
        served = [k for k in POOL_KEYS if getattr(self, k)]
        if self.provider not in (*NAMES, "echo", "scripted"):
            raise ValueError(f"client: unknown provider {self.provider!r}; choose one of {sorted(NAMES)}")
        if self.batch_size < 1 or (self.num_proc is not None and self.num_proc < 1) or (self.queue_size is not None and self.queue_size < 1):
            raise ValueError("client: batch_size, num_proc and queue_size must be 1 or more")
        if len(served) > 1:
            raise ValueError(f"client: give one of {POOL_KEYS}, not {served}")
        if served and self.provider != "vllm_online":
            raise ValueError(f"client: {served[0]} needs provider vllm_online")
        if self.model is None and self.provider in ("openai", "claude", "vllm_offline"):
            raise ValueError(f"client: provider {self.provider} needs a model")
        if not self.provider.startswith("vllm") and self.engine != EngineConfig():
            raise ValueError(f"client: engine has no meaning for provider {self.provider}")
        if twice := sorted({f.name for f in fields(EngineConfig)} & set(self.init)):
            raise ValueError(f"client: {twice} belong in engine, not in init")
        known = {f.name for f in fields(by_name(self.provider).options_class)}
        if unknown := sorted(set(self.options) - known):
            raise ValueError(f"client: unknown options {unknown}; {self.provider} has {sorted(known)}")

    def is_pool(self) -> bool:
        return any(getattr(self, k) for k in POOL_KEYS)

    def kind(self) -> str:
        """What a step needs to run: an engine of its own, servers that are to be started, servers that run, or a hosted API."""
        if self.provider == "vllm_online":
            return "vllm_online" if self.is_pool() else "vllm_pool"
        return self.provider if self.provider == "vllm_offline" else "api"

    def reuse_key(self) -> str:
        """Equal for clients that can share a provider; options of single requests do not count."""
        kept = ("provider", "model", "init", "engine", *POOL_KEYS)
        return json.dumps({k: v for k, v in asdict(self).items() if k in kept}, sort_keys=True, default=str)

    def urls(self, root: Path) -> list[str]:
        """Servers of the pool, from a list, a file with one a line, or files that a pattern matches."""
        if not self.is_pool():
            return []
        if self.base_urls:
            return list(self.base_urls)
        files = [_path(self.hosts_file, root)] if self.hosts_file else [Path(p) for p in sorted(glob.glob(str(_path(self.url_glob, root))))]
        if missing := [str(f) for f in files if not f.is_file()]:
            raise ValueError(f"no such file: {missing}")
        found = [u for f in files for line in f.read_text(encoding="utf-8").splitlines() if (u := line.strip())]
        if not found:
            raise ValueError("no server was found for the pool")
        return found

    def provider_spec(self, root: Path = Path(".")) -> ProviderSpec:
        engine = self.engine.settings() if self.provider == "vllm_offline" else {}
        # Steps whose clients can share a provider find it again in their workers.
        return ProviderSpec(self.provider, self.model or "", {**self.init, **engine}, self.options, self.gen_kwargs, tuple(self.urls(root)), self.reuse_key())


@dataclass(frozen=True)
class StepConfig:
    name: str
    type: str = "annotate"
    prompt: str | None = None
    prompt_file: str | None = None
    system_prompt: str | None = None
    system_prompt_file: str | None = None
    output_schema: dict | None = None
    output_schema_file: str | None = None
    prompts: list | str | None = None
    num_samples: int | None = None
    client: dict | None = None
    task_prefix: str | None = None
    sort_by_length: bool | str = False
    num_retries_invalid: int = 5
    max_samples_per_output_file: int = 1000
    upload_every_n_samples: int | None = None
    backup: str | None = None
    rename: dict = field(default_factory=dict)
    drop_columns: list = field(default_factory=list)
    filter_invalid: bool = False
    keep_messages: bool = False
    force_data_preparation: bool = False

    def __post_init__(self) -> None:
        bad = lambda text: ValueError(f"step {self.name!r}: {text}")
        if not str(self.name).strip():
            raise ValueError("a step needs a name")
        if self.type not in ("annotate", "generate"):
            raise bad("type must be annotate or generate")
        for key in ("prompt", "system_prompt", "output_schema"):
            if getattr(self, key) is not None and getattr(self, f"{key}_file") is not None:
                raise bad(f"give one of {key} and {key}_file")
        if self.type == "annotate":
            if self.prompt is None and self.prompt_file is None:
                raise bad("an annotate step needs prompt or prompt_file")
            if self.prompts is not None or self.num_samples is not None:
                raise bad("prompts and num_samples belong to generate steps")
        elif self.prompts is None:
            raise bad("a generate step needs prompts")
        if self.filter_invalid and self.output_schema is None and self.output_schema_file is None:
            raise bad("filter_invalid needs an output schema")
        if self.sort_by_length not in (False, True, "shortest_first", "longest_first"):
            raise bad("sort_by_length must be true, false, shortest_first or longest_first")
        if self.num_retries_invalid < 0 or self.max_samples_per_output_file < 0:
            raise bad("numbers must not be negative")

    @property
    def prefix(self) -> str:
        return f"{self.name}_" if self.task_prefix is None else self.task_prefix

    def _text(self, key: str, root: Path) -> str | None:
        if (value := getattr(self, key)) is not None:
            return value
        file = getattr(self, f"{key}_file")
        return None if file is None else text_of(file, root)

    def template(self, root: Path) -> str:
        """The prompt template; a generate step without one takes each prompt as it is."""
        text = self._text("prompt", root)
        return "{prompt}" if text is None else text

    def system(self, root: Path) -> str | None:
        return self._text("system_prompt", root)

    def schema(self, root: Path) -> dict | None:
        if self.output_schema is not None:
            return self.output_schema
        return as_schema(_path(self.output_schema_file, root).read_text(encoding="utf-8")) if self.output_schema_file else None

    def all_prompts(self, root: Path) -> list[str]:
        """Prompts of a generate step: one is repeated ``num_samples`` times, of several the first so many are taken."""
        if isinstance(self.prompts, str):
            found = [line for line in text_of(self.prompts, root).splitlines() if line.strip()]
        else:
            found = list(self.prompts or ())
        if self.num_samples:
            found = found * self.num_samples if len(found) == 1 else found[: self.num_samples]
        if not found:
            raise ValueError(f"step {self.name!r}: there are no prompts")
        return found


def text_of(file: str, root: Path) -> str:
    """Text of a file; a JSON catalogue becomes its bullet list."""
    path = _path(file, root)
    text = path.read_text(encoding="utf-8")
    return catalog_text(json.loads(text)) if path.suffix.lower() == ".json" else text


def catalog_text(data: Any) -> str:
    """Lines "- `code` — description" of a list of entries, after its instruction. An entry is a string or a mapping; one without a code is left out."""
    intro, items = None, data
    if isinstance(data, dict):
        intro = data.get("instruction")
        named = next((k for k in CATALOG_LISTS if k in data), None)
        items = data[named] if named else next((v for v in data.values() if isinstance(v, list)), [])
    if not isinstance(items, list):
        raise ValueError("a catalogue is a list of entries, or an object that holds one")
    entries = [{"code": item} if isinstance(item, str) else item for item in items if isinstance(item, (str, dict))]
    told = lambda item, keys: next((item[k] for k in keys if item.get(k)), None)
    lines = [intro.strip()] if isinstance(intro, str) and intro.strip() else []
    for code, detail in ((told(e, CATALOG_CODES), told(e, CATALOG_DETAILS)) for e in entries):
        if code is not None:
            detail = "" if detail is None else str(detail).strip()
            lines.append(f"- `{str(code).strip()}`" + (f" — {detail}" if detail else ""))
    if not lines:
        raise ValueError("the catalogue holds no entries")
    return "\n".join(lines)


@dataclass(frozen=True)
class PipelineConfig:
    output_dir: str
    steps: list
    dataset: DatasetConfig | None = None
    client: dict | None = None
    backup: str | None = None
    idx_column: str = "idx"
    overwrite: bool = False
    verbose: bool = True
    log_level: str = "INFO"
    config_dir: str = "."

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        put("steps", [s if isinstance(s, StepConfig) else strict(StepConfig, s, "step") for s in self.steps])
        if isinstance(self.dataset, dict):
            put("dataset", strict(DatasetConfig, self.dataset, "dataset"))
        if "://" not in str(self.output_dir):
            put("output_dir", str(_path(self.output_dir, Path(self.config_dir).absolute())))
        if not self.steps:
            raise ValueError("a pipeline needs a step")
        for what, values in (("names", [s.name for s in self.steps]), ("prefixes", [s.prefix for s in self.steps])):
            if twice := sorted({v for v in values if values.count(v) > 1}):
                raise ValueError(f"{what} of steps must differ: {twice}")
        if late := [s.name for s in self.steps[1:] if s.type == "generate"]:
            raise ValueError(f"only the first step can generate, not {late}")
        if (self.steps[0].type == "annotate") != (self.dataset is not None):
            raise ValueError("a dataset is needed exactly if the first step annotates")
        for s in self.steps:
            self.step_client(s)

    def step_client(self, step: StepConfig) -> ClientConfig:
        """The step's block over the pipeline's. Another provider inherits neither options nor constructor arguments."""
        base, own = dict(self.client or {}), dict(step.client or {})
        if own.get("provider", base.get("provider")) != base.get("provider"):
            for key in ("init", "options", "engine", "gen_kwargs", *POOL_KEYS):
                base.pop(key, None)
        if any(k in own for k in POOL_KEYS):
            for key in POOL_KEYS:
                base.pop(key, None)
        merged = {**base, **own, **{k: {**(base.get(k) or {}), **(own.get(k) or {})} for k in MERGED if k in base or k in own}}
        return strict(ClientConfig, merged, f"step {step.name!r}: client")

    def step_dir(self, number: int) -> str:
        return f"{self.output_dir}/{number + 1:02d}-{self.steps[number].name}"

    def describe(self) -> list[dict[str, Any]]:
        """What each step needs, for whoever starts its servers."""
        out = []
        for k, s in enumerate(self.steps):
            c = self.step_client(s)
            out.append({"name": s.name, "type": s.type, "kind": c.kind(), "provider": c.provider, "model": c.model, "servers": c.pool.servers, "tensor_parallel_size": c.engine.tensor_parallel_size, "output_dir": self.step_dir(k)})
        return out


def load_file(path: str | Path) -> dict:
    """Mapping in a JSON file, or a YAML file by any other name."""
    p = Path(path).expanduser()
    if not p.is_file():
        raise FileNotFoundError(f"no such file: {p}")
    text = p.read_text(encoding="utf-8")
    if p.suffix.lower() == ".json":
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text)
    if not isinstance(data, dict):
        raise ValueError(f"{p} must hold a mapping")
    return data


def load_pipeline(path: str | Path, step_overrides: dict[str, dict] | None = None, **overrides: Any) -> PipelineConfig:
    """Configuration of a file, with keys replaced and step clients merged over."""
    data = {**load_file(path), **{k: v for k, v in overrides.items() if v is not None}}
    data.setdefault("config_dir", str(Path(path).expanduser().absolute().parent))
    for name, client in (step_overrides or {}).items():
        steps = [s for s in data.get("steps", ()) if s.get("name") == name]
        if not steps:
            raise ValueError(f"no step is named {name!r}")
        steps[0]["client"] = {**(steps[0].get("client") or {}), **client}
    return strict(PipelineConfig, data, str(path))
