"""Settings: nested dataclasses from YAML with ${NAME} values from the environment."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, is_dataclass

try:
    import yaml
except ImportError:  # only files need it
    yaml = None


@dataclass
class Retrieval:
    source_depth: int = 240
    fused_depth: int = 200
    rrf_k: int = 60
    intent_source_depth: int = 50
    intent_depth: int = 10


@dataclass
class Models:
    backend: str = "offline"
    endpoint: str = ""
    api_key: str = ""
    dimension: int = 64


@dataclass
class Generation:
    per_article_chars: int = 2400
    total_chars: int = 48_000
    max_tokens: int = 3000


@dataclass
class Settings:
    retrieval: Retrieval = field(default_factory=Retrieval)
    models: Models = field(default_factory=Models)
    generation: Generation = field(default_factory=Generation)

    def problems(self) -> list[str]:
        out = []
        if self.models.backend not in ("offline", "remote"):
            out.append(f"unknown backend {self.models.backend}")
        if self.models.backend == "remote" and not (self.models.endpoint and self.models.api_key):
            out.append("a remote backend needs an endpoint and a key")
        if self.models.dimension <= 0:
            out.append("the dimension must be positive")
        if self.retrieval.fused_depth > 2 * self.retrieval.source_depth:
            out.append("the fused depth exceeds what the sources give")
        return out


def expanded(value):
    """Strings with ${NAME} replaced; names that aren't set become empty."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), value)
    if isinstance(value, dict):
        return {k: expanded(v) for k, v in value.items()}
    return [expanded(v) for v in value] if isinstance(value, list) else value


def build(kind, values: dict):
    """A dataclass from a dict; names that it doesn't have are dropped."""
    known = {f.name: f for f in fields(kind)}
    made = kind()
    for name, value in (values or {}).items():
        if name in known:
            now = getattr(made, name)
            setattr(made, name, build(type(now), value) if is_dataclass(now) else value)
    return made


def load(path: str) -> Settings:
    if yaml is None:
        raise RuntimeError("reading settings files needs yaml")
    with open(path, encoding="utf-8") as f:
        return build(Settings, expanded(yaml.safe_load(f) or {}))
