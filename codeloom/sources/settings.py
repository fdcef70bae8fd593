"""Configuration, presets and the list of watched repositories."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

FILE = "codeloom.toml"


@dataclass
class Config:
    default_repo: str | None = None
    default_capsule: str | None = None
    max_tokens: int | None = None
    max_files: int | None = None
    include_tests: bool = False
    auto_index: bool = False
    mcp_max_tokens: int | None = None
    mcp_max_files: int | None = None
    architecture: dict | None = None


def load_config(path: str | None = None) -> Config:
    """From the given file, $CODELOOM_CONFIG, ./codeloom.toml or nothing; a file
    that was asked for must exist."""
    asked = path or os.environ.get("CODELOOM_CONFIG")
    at = Path(asked or FILE)
    if not at.exists():
        if asked:
            raise FileNotFoundError(f"no configuration at {at}")
        return Config()
    values = tomllib.loads(at.read_text())
    known = {f.name for f in fields(Config)}
    return Config(**{k: v for k, v in values.items() if k in known})


def state_dir() -> Path:
    if own := os.environ.get("CODELOOM_HOME"):
        return Path(own)
    if state := os.environ.get("XDG_STATE_HOME"):
        return Path(state) / "codeloom"
    return Path.home() / ".local/state/codeloom"


def watched() -> list[str]:
    try:
        lines = (state_dir() / "watched").read_text().splitlines()
    except OSError:
        return []
    return sorted({x.strip() for x in lines if x.strip()})


def set_watched(repos: list[str]) -> None:
    folder = state_dir()
    folder.mkdir(parents=True, exist_ok=True)
    made = folder / ".watched"
    made.write_text("".join(f"{x}\n" for x in sorted(set(repos))))
    os.replace(made, folder / "watched")


def watch(repo: str) -> None:
    set_watched([*watched(), repo])


def unwatch(repo: str) -> None:
    set_watched([x for x in watched() if x != repo])
