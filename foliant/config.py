"""Options from TOML or JSON files, overridden by the environment."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Mapping
from pathlib import Path


def load(path: str | Path | None = None, prefix: str = "FOLIANT_", environ: Mapping[str, str] | None = None) -> dict[str, object]:
    """Options of a file, nested tables joined by "_" in lower case; a variable PREFIX_NAME wins over the file's name.

    Values from the environment are JSON where they can be read as such, else text. A missing file has no options."""
    found: dict[str, object] = {}
    file = Path(path) if path else None
    if file and file.exists():
        raw = file.read_bytes().decode()
        made = tomllib.loads(raw) if file.suffix.lower() == ".toml" else json.loads(raw or "{}")

        def flat(d: Mapping, before: str) -> None:
            for k, v in d.items():
                flat(v, f"{before}{k}_") if isinstance(v, Mapping) else found.__setitem__(f"{before}{k}".lower(), v)

        flat(made, "")
    for name, value in (os.environ if environ is None else environ).items():
        if name.startswith(prefix):
            try:
                found[name[len(prefix) :].lower()] = json.loads(value)
            except ValueError:
                found[name[len(prefix) :].lower()] = value
    return found
