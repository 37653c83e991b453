"""Settings from the environment and a .env file, typed, read once."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import lru_cache


@dataclass(frozen=True)
class Settings:
    # fixed values: the settings' names and defaults
    debug: bool = False
    max_image_size_mb: int = 50
    max_concurrent_jobs: int = 10
    job_timeout_seconds: int = 300
    model_path: str = ""
    use_gpu: bool = False
    ocr_confidence_threshold: float = 0.6
    target_accuracy: float = 0.95
    smoothing_window: int = 11


def _env_file(path: str) -> dict[str, str]:
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = (line.strip().split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#"))
        return {k.strip().lower(): v.strip().strip("\"'") for k, v in pairs}


def load(env: dict[str, str] | None = None, path: str = ".env") -> Settings:
    """Names are case-insensitive; the environment goes before the file."""
    have = _env_file(path) | {k.lower(): v for k, v in (os.environ if env is None else env).items()}
    kinds = {"bool": lambda v: v.strip().lower() in ("1", "true", "yes", "on"), "int": int, "float": float, "str": str}
    return Settings(**{f.name: kinds[str(f.type)](have[f.name]) for f in fields(Settings) if f.name in have})


@lru_cache
def settings() -> Settings:
    return load()


def doctor() -> dict[str, bool]:
    """Which optional parts this installation has."""
    from importlib.util import find_spec

    return {name: find_spec(name) is not None for name in ("pyarrow", "pandas", "numpy", "duckdb", "onnxruntime")}
