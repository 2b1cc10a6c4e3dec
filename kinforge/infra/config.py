"""Typed configuration: defaults, YAML file, key=value overrides, the runner's environment."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from types import UnionType
from typing import get_args, get_origin, get_type_hints

import yaml


@dataclass
class Run:
    name: str = "run"
    tier: str = "smoke"
    seed: int = 17
    seeds: list[int] = field(default_factory=lambda: [17, 23, 29])


@dataclass
class Blocking:
    window: int = 0
    bm25_k: int = 10
    knn_k: int = 10


@dataclass
class Score:
    fields: list[str] = field(default_factory=lambda: ["given_name", "family_name", "dob"])
    threshold: float = 0.9
    max_pairs: float = 1e6


@dataclass
class Serialize:
    scheme: str = "colval"
    missing: str = "token"


@dataclass
class Data:
    dataset: str = "historical_50k"
    n_records: int | None = None


@dataclass
class Model:
    """The student encoder: hashed character n-grams of ``dim`` buckets."""

    kind: str = "hashed_ngram"
    dim: int = 256
    max_len: int = 192


@dataclass
class Train:
    batch_size: int = 64
    epochs: int = 2
    lr: float = 3e-4
    loss: str = "infonce"
    miner: str = "inbatch"
    miner_k: int = 10
    augment: str = "none"
    temperature: float = 0.05
    margin: float = 0.2


@dataclass
class Infra:
    """Cluster settings that a session is started with; 0 leaves them to the submitter."""

    master: str | None = None
    shuffle_partitions: int = 0
    checkpoint_dir: str | None = None


@dataclass
class Paths:
    data: str = "data"
    artifacts: str = "artifacts"


@dataclass
class Config:
    run: Run = field(default_factory=Run)
    blocking: Blocking = field(default_factory=Blocking)
    score: Score = field(default_factory=Score)
    serialize: Serialize = field(default_factory=Serialize)
    data: Data = field(default_factory=Data)
    model: Model = field(default_factory=Model)
    train: Train = field(default_factory=Train)
    infra: Infra = field(default_factory=Infra)
    paths: Paths = field(default_factory=Paths)


def _typed(value: object, kind: object) -> object:
    """``value`` as a field's declared kind."""
    if isinstance(kind, UnionType):  # a kind or None
        if value is None or str(value).lower() in ("", "none", "null"):
            return None
        kind = next(k for k in kind.__args__ if k is not type(None))
    if kind is bool:
        return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes")
    if get_origin(kind) is list:
        items = value if isinstance(value, list) else [x.strip() for x in str(value).strip("[]").split(",") if x.strip()]
        return [get_args(kind)[0](x) for x in items]
    return kind(value)


def _merge(config: object, values: dict) -> None:
    kinds = get_type_hints(type(config))
    for key, value in values.items():
        if key not in kinds:
            raise KeyError(f"unknown setting {key!r}")
        old = getattr(config, key)
        if dataclasses.is_dataclass(old):
            _merge(old, value)
        else:
            setattr(config, key, _typed(value, kinds[key]))


def load_config(path: str | None = None, overrides: list[str] | None = None) -> Config:
    """Defaults, then the file, then ``section.key=value`` overrides."""
    config = Config()
    if path:
        _merge(config, yaml.safe_load(Path(path).read_text()) or {})
    for item in overrides or []:
        dotted, _, value = item.partition("=")
        section, _, key = dotted.partition(".")
        _merge(config, {section: {key: value}})
    return config


def load_config_from_env(environ: Mapping[str, str] = os.environ) -> Config:
    """The configuration a runner hands on.

    ``KINFORGE_OVERRIDES`` holds a JSON list of overrides; ``KINFORGE_TIER`` and
    ``KINFORGE_ARTIFACTS`` set the run's tier and the registry's folder.
    """
    config = load_config(overrides=json.loads(environ.get("KINFORGE_OVERRIDES", "[]")))
    config.run.tier = environ.get("KINFORGE_TIER", config.run.tier)
    config.paths.artifacts = environ.get("KINFORGE_ARTIFACTS", config.paths.artifacts)
    return config


def config_hash(config: Config) -> str:
    """Twelve hex digits of the sorted settings."""
    return hashlib.sha256(json.dumps(dataclasses.asdict(config), sort_keys=True).encode()).hexdigest()[:12]
