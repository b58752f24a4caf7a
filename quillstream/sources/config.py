"""Settings from a dictionary, a YAML file or the environment, with ${NAME} substitution."""

from __future__ import annotations

import dataclasses
import json
import os
import re
from dataclasses import dataclass, field


@dataclass
class Provider:
    """One language-model provider."""

    model: str = "mock"
    base_url: str | None = None
    api_key: str | None = None
    max_tokens: int = 1000
    temperature: float = 0.1
    timeout: int = 30
    retry_attempts: int = 3
    retry_delay: float = 1.0


@dataclass
class Settings:
    chunk_size: int = 1024 * 1024
    max_records_per_file: int = 0
    snapshot_interval: int = 100
    embedding_dimension: int = 64
    search_strategy: str = "exact"
    semantic_threshold: float = 0.7
    max_semantic_results: int = 100
    default_limit: int = 100
    max_limit: int = 1000
    provider: str = "mock"
    fallback: bool = True
    providers: dict[str, Provider] = field(default_factory=lambda: {"mock": Provider()})

    def clamp(self, limit: int | None) -> int | None:
        """The default for no limit, none for 0, and max_limit at most."""
        if limit == 0:
            return None
        return min(self.default_limit if limit is None else limit, self.max_limit)


def substitute(value, env=os.environ):
    """${NAME} and ${NAME:default} anywhere in strings."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::([^}]*))?\}", lambda m: env.get(m[1], m[2] or ""), value)
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    return [substitute(v, env) for v in value] if isinstance(value, list) else value


def from_dict(values: dict, env=os.environ) -> Settings:
    """Unknown keys are an error; numbers and booleans given as text are converted."""
    values = substitute(values, env)
    known = {f.name: f for f in dataclasses.fields(Settings)}
    if extra := set(values) - set(known):
        raise ValueError(f"unknown settings: {sorted(extra)}")
    made = {}
    for k, v in values.items():
        made[k] = {n: Provider(**{a: _typed(Provider, a, b) for a, b in p.items()}) for n, p in v.items()} if k == "providers" else _typed(Settings, k, v)
    return Settings(**made)


def _typed(kind, name: str, value):
    want = next(f.type for f in dataclasses.fields(kind) if f.name == name)
    if isinstance(value, str) and "bool" in want:
        return value.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(value, str) and want in ("int", "float"):
        return (int if want == "int" else float)(value)
    return value


def from_file(path: str, env=os.environ) -> Settings:
    """YAML where a YAML reader is installed, else JSON."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return from_dict(json.loads(text), env)
    return from_dict(yaml.safe_load(text) or {}, env)


def from_env(env=os.environ, prefix: str = "QUILL_") -> Settings:
    """QUILL_<SETTING> and QUILL_<PROVIDER>_<SETTING> for the providers openai, anthropic and local."""
    plain = {f.name: env[prefix + f.name.upper()] for f in dataclasses.fields(Settings) if prefix + f.name.upper() in env and f.name != "providers"}
    providers = {"mock": {}}
    for name in ("openai", "anthropic", "local"):
        held = {f.name: env[k] for f in dataclasses.fields(Provider) if (k := f"{prefix}{name.upper()}_{f.name.upper()}") in env}
        if held:
            providers[name] = held
    return from_dict(plain | {"providers": providers}, env)


def save(settings: Settings, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(dataclasses.asdict(settings), f, indent=2)
