"""Runs on disk: folders with results, their catalogue, and run configurations."""

from __future__ import annotations

import datetime
import json
import re
import shutil
from pathlib import Path

from tabulon.sources.writers import write_json

#: Keys that a run configuration may have.
CONFIG = ("data", "target", "task", "models", "metric", "folds", "quick", "drop", "keep", "sample", "seed", "horizon", "unit", "group", "outliers", "contamination", "clusters", "out", "date", "value", "inputs", "holidays", "combine", "smote", "class_weights", "log_target", "threshold")


def slug(text: str) -> str:
    return re.sub(r"-+", "-", re.sub(r"[^a-z0-9]+", "-", text.lower())).strip("-") or "run"


def create(root: str | Path, name: str, now: datetime.datetime | None = None) -> Path:
    """A new folder named by time and name; a number is added if it is taken."""
    base = f"{(now or datetime.datetime.now()):%Y%m%d-%H%M%S}_{slug(name)}"
    for k in range(1, 10_000):
        path = Path(root) / (base if k == 1 else f"{base}-{k}")
        try:
            path.mkdir(parents=True)
            return path
        except FileExistsError:
            continue
    raise FileExistsError(base)


def save(path: Path, about: dict) -> None:
    write_json(about, path / "run.json")


def listed(root: str | Path) -> list[dict]:
    """All runs, the newest first."""
    found = [p for p in Path(root).glob("*/run.json")] if Path(root).exists() else []
    return [{**json.loads(p.read_text()), "name": p.parent.name} for p in sorted(found, key=lambda p: p.parent.name, reverse=True)]


def resolve(root: str | Path, ref: str) -> Path:
    """A run by path, name, part of its name, or 'latest'."""
    if Path(ref).is_dir():
        return Path(ref)
    names = [r["name"] for r in listed(root)]
    hits = names[:1] if ref == "latest" else [n for n in names if n == ref] or [n for n in names if ref in n]
    if len(hits) != 1:
        raise LookupError(f"{len(hits)} runs match {ref!r}" + (f": {', '.join(hits[:5])}" if hits else ""))
    return Path(root) / hits[0]


def model_path(root: str | Path, ref: str) -> Path:
    """A saved model by its own path, or by its run's path, name, part of its name, or 'latest' (the newest run with one)."""
    if (Path(ref) / "about.json").exists():
        return Path(ref)
    if ref == "latest":
        for r in listed(root):
            if (Path(root) / r["name"] / "model" / "about.json").exists():
                return Path(root) / r["name"] / "model"
    found = resolve(root, ref) / "model"
    if not (found / "about.json").exists():
        raise LookupError(f"the run {ref!r} has no model")
    return found


def prune(root: str | Path, keep: int | None = None, older_than: datetime.timedelta | None = None, now: datetime.datetime | None = None, dry: bool = False) -> list[str]:
    """Remove runs outside the newest keep ones, and those older than a span."""
    now = now or datetime.datetime.now()
    gone = []
    for k, run in enumerate(listed(root)):
        made = datetime.datetime.strptime(run["name"][:15], "%Y%m%d-%H%M%S")
        if keep is not None and k >= keep or older_than is not None and now - made > older_than:
            gone.append(run["name"])
            if not dry:
                shutil.rmtree(Path(root) / run["name"])
    return gone


def load_config(path: str | Path) -> dict:
    """A run configuration in JSON, or in YAML where its package is there; data is relative to the file."""
    text = Path(path).read_text()
    if str(path).endswith((".yml", ".yaml")):
        try:
            import yaml

            config = yaml.safe_load(text)
        except ImportError:
            config = _simple_yaml(text)
    else:
        config = json.loads(text)
    unknown = sorted(set(config) - set(CONFIG))
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    if "data" in config and "://" not in str(config["data"]) and not Path(config["data"]).is_absolute():
        config["data"] = str(Path(path).parent / config["data"])
    return config


def _simple_yaml(text: str) -> dict:
    """Flat 'key: value' lines with scalars and [a, b] lists."""
    out = {}
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line or line.startswith("#"):
            continue
        key, _, value = line.partition(":")
        out[key.strip()] = _scalar(value.strip())
    return out


def _scalar(value: str) -> object:
    if value.startswith("[") and value.endswith("]"):
        return [_scalar(v.strip()) for v in value[1:-1].split(",") if v.strip()]
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            continue
    return None if value in ("", "null", "~") else value.strip("'\"")
