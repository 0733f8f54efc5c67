"""Settings, with the defaults that queries use."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from pathlib import Path


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Segmentation:
    window: int = 6
    boundary_misses: int = 2
    max_turns: int = 60
    max_gap_minutes: float = 120
    min_turns: int = 2
    hold_open_on_failure: bool = True
    require_files: bool = True


@dataclass(frozen=True)
class Config:
    segmentation: Segmentation = field(default_factory=Segmentation)
    model: str = "claude-haiku-4-5"
    issue_pattern: str = r"\b([A-Z][A-Z0-9]{1,9}-\d+)\b"
    retention_days: int = 30
    token_budget: int = 1500
    repos: tuple[str, ...] = ()


# The caps and costs that rendering and estimates use.
TURN_CHARS, THINKING_CHARS, TOOL_CHARS, RESULT_HEAD, RESULT_TAIL, SEGMENT_CHARS = 2000, 400, 300, 300, 600, 12000
DOLLARS_IN, DOLLARS_OUT, CHARS_PER_TOKEN, TOKENS_OUT = 1.0, 5.0, 4, 400


def _built(cls, values: dict):
    known = {f.name: f for f in dataclasses.fields(cls)}
    if unknown := sorted(values.keys() - known.keys()):
        raise ConfigError(f"unknown settings: {', '.join(unknown)}")
    return cls(**values)


def load_config(path: str | Path, model_variable: str = "WORKLORE_MODEL") -> Config:
    """Read a JSON object; a missing file gives the defaults, anything malformed a ConfigError."""
    path = Path(path)
    values: dict = {}
    if path.exists():
        try:
            values = json.loads(path.read_text(encoding="utf-8"))
        except ValueError as e:
            raise ConfigError(f"{path} is not JSON") from e
        if not isinstance(values, dict):
            raise ConfigError(f"{path} does not hold an object")
    values = dict(values)
    if isinstance(values.get("segmentation"), dict):
        values["segmentation"] = _built(Segmentation, values["segmentation"])
    elif "segmentation" in values:
        raise ConfigError("segmentation is not an object")
    if "repos" in values:
        values["repos"] = tuple(values["repos"])
    if model := os.environ.get(model_variable):
        values["model"] = model
    return _built(Config, values)


def link_repos(path: str | Path, root: str, repos: list[str]) -> tuple[str, ...]:
    """Add sibling repositories to a config file; a repository is never linked to itself, and linking again is harmless."""
    path = Path(path)
    values = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
    merged = dict.fromkeys([*values.get("repos", []), *(r for r in repos if os.path.realpath(r) != os.path.realpath(root))])
    values["repos"] = list(merged)
    path.write_text(json.dumps(values, indent=2), encoding="utf-8")
    return tuple(merged)


def members(root: str, repos: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(name, root) of a workspace's repositories, the own one first; missing ones are left out, repeated ones once."""
    out: dict[str, str] = {}
    for r in (root, *repos):
        real = os.path.realpath(os.path.join(root, r))
        if os.path.isdir(real) and real not in out:
            out[real] = os.path.basename(real)
    return [(name, real) for real, name in out.items()]
