"""Bundles of JSON artifacts with an index of SHA-256 digests; a changed file fails on load."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path


def save(folder: str, artifacts: dict[str, str]) -> None:
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    index = {}
    for name, text in artifacts.items():
        (root / name).write_text(text)
        index[name] = hashlib.sha256(text.encode()).hexdigest()
    (root / "bundle.json").write_text(json.dumps({"sha256": index}, sort_keys=True))


def load(folder: str) -> dict[str, str]:
    root = Path(folder)
    index = json.loads((root / "bundle.json").read_text())["sha256"]
    out = {}
    for name, digest in index.items():
        if not (root / name).exists():
            raise FileNotFoundError(f"{name} is in the index but not in {folder}")
        text = (root / name).read_text()
        if hashlib.sha256(text.encode()).hexdigest() != digest:
            raise ValueError(f"{name} differs from its digest")
        out[name] = text
    return out
