"""Run configuration: defaults, then a YAML section, then the environment, then arguments."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

ENV_PREFIX = "SPANLAB_"


class ConfigError(ValueError):
    """A setting is unknown or out of range."""


@dataclass(frozen=True)
class Config:
    strategies: tuple[str, ...] = ("fixed_size", "token_window", "sentence_split", "rcts_512", "rcts_1024", "clause_aware")
    models: tuple[str, ...] = ("hashed_64",)
    top_k: int = 10
    depth: int = 5
    token_budget: int = 128
    min_overlap: int = 100
    resamples: int = 10_000
    alpha: float = 0.05
    seed: int = 42
    output_dir: str = "results"
    overrides: dict = field(default_factory=dict)

    def checked(self) -> Config:
        from spanlab.operators.chunkers import REGISTRY
        from spanlab.operators.vector import EMBEDDERS

        wrong = [f"unknown strategies {sorted(set(self.strategies) - set(REGISTRY))}"] if set(self.strategies) - set(REGISTRY) else []
        wrong += [f"unknown models {sorted(set(self.models) - set(EMBEDDERS))}"] if set(self.models) - set(EMBEDDERS) else []
        wrong += [f"{n} is a positive whole number" for n in ("top_k", "depth", "token_budget", "min_overlap", "resamples") if isinstance(getattr(self, n), bool) or not isinstance(getattr(self, n), int) or getattr(self, n) < 1]
        wrong += ["alpha is between 0 and 1"] if not 0 < self.alpha < 1 else []
        if wrong:
            raise ConfigError("; ".join(wrong))
        return self


def _typed(name: str, value, default):
    try:
        if isinstance(default, tuple):
            return tuple(x.strip() for x in value.split(",") if x.strip()) if isinstance(value, str) else tuple(value)
        if isinstance(value, str) and isinstance(default, (int, float)):
            return type(default)(value)
    except ValueError as problem:
        raise ConfigError(f"{name}: {value!r}") from problem
    return value


def load(path: str | None = None, section: str = "benchmark", env: dict[str, str] | None = None, **arguments) -> Config:
    default = Config()
    names = {f.name for f in fields(Config)}
    given: dict = {}
    if path:
        import yaml

        given |= (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).get(section) or {}
    given |= {k[len(ENV_PREFIX) :].lower(): v for k, v in (os.environ if env is None else env).items() if k.startswith(ENV_PREFIX) and k[len(ENV_PREFIX) :].lower() in names}
    given |= {k: v for k, v in arguments.items() if v is not None}
    if unknown := set(given) - names:
        raise ConfigError(f"unknown settings: {sorted(unknown)}")
    return replace(default, **{k: _typed(k, v, getattr(default, k)) for k, v in given.items()}).checked()


@dataclass(frozen=True)
class EvidenceConfig:
    """Settings of the anchored-evidence benchmark."""

    dataset_path: str = "evidence.json"
    output_path: str = "results/evidence.json"
    strategies: tuple[str, ...] = ("clause_aware", "token_window", "rcts_512")
    retrieval_depth: int = 5
    context_budget_tokens: int = 128
    token_window_tokens: int = 64
    token_window_overlap: int = 8
    rcts_chunk_chars: int = 512
    rcts_chunk_overlap: int = 50
    clause_aware_max_chars: int = 1200

    def chunkers(self) -> dict[str, dict]:
        """Parameters of strategies, as `chunkers.chunk` takes them."""
        recursive = {"size": self.rcts_chunk_chars, "overlap": self.rcts_chunk_overlap}
        window = {"window": self.token_window_tokens, "overlap": self.token_window_overlap}
        return {"token_window": window, "rcts_512": recursive, "clause_aware": {"max_chars": self.clause_aware_max_chars}}

    def checked(self) -> EvidenceConfig:
        from spanlab.operators.chunkers import REGISTRY

        whole = lambda n, least: isinstance(getattr(self, n), int) and not isinstance(getattr(self, n), bool) and getattr(self, n) >= least
        wrong = [f"{n} is a path" for n in ("dataset_path", "output_path") if not isinstance(getattr(self, n), str)]
        if not isinstance(self.strategies, tuple) or not self.strategies or len(set(self.strategies)) < len(self.strategies):
            wrong.append("strategies are different names, one at least")
        elif unknown := set(self.strategies) - set(REGISTRY):
            wrong.append(f"unknown strategies {sorted(unknown)}")
        positive = ("retrieval_depth", "context_budget_tokens", "token_window_tokens", "rcts_chunk_chars", "clause_aware_max_chars")
        wrong += [f"{n} is a positive whole number" for n in positive if not whole(n, 1)]
        for n, most in (("token_window_overlap", "token_window_tokens"), ("rcts_chunk_overlap", "rcts_chunk_chars")):
            if not whole(n, 0) or (whole(most, 1) and getattr(self, n) >= getattr(self, most)):
                wrong.append(f"{n} is a whole number below {most}")
        if wrong:
            raise ConfigError("; ".join(wrong))
        return self


def load_evidence(path: str | None = None, **arguments) -> EvidenceConfig:
    """Defaults, then the section evidence of a YAML file (all of the file where it has no sections), then arguments. Paths of
    the file are relative to it."""
    names = {f.name for f in fields(EvidenceConfig)}
    given: dict = {}
    if path:
        import yaml

        content = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        if not isinstance(content, dict):
            raise ConfigError("a configuration is an object")
        given = dict(content.get("evidence") or {}) if "evidence" in content or "benchmark" in content else dict(content)
        if unknown := set(given) - names:
            raise ConfigError(f"unknown settings: {sorted(unknown)}")
        for n in ("dataset_path", "output_path"):
            if isinstance(given.get(n), str):
                given[n] = str(Path(path).resolve().parent / given[n])
        if isinstance(given.get("strategies"), list):
            given["strategies"] = tuple(given["strategies"])
    given |= {k: v for k, v in arguments.items() if v is not None}
    if unknown := set(given) - names:
        raise ConfigError(f"unknown settings: {sorted(unknown)}")
    return replace(EvidenceConfig(), **given).checked()
