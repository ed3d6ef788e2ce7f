"""Files of a path: one file, a folder or a pattern."""

from __future__ import annotations

import glob
import os


def expand(path: str, *suffixes: str) -> list[str]:
    path = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
    found = [os.path.join(path, f) for f in os.listdir(path)] if os.path.isdir(path) else glob.glob(path)
    out = sorted(f for f in found if f.lower().endswith(suffixes))
    if not out:
        raise FileNotFoundError(f"no {' or '.join(suffixes)} file at {path}")
    return out
