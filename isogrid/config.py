"""Settings of the two pipelines, checked, and read from or written to JSON files."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, fields
from pathlib import Path
from typing import Literal


def _load(cls, path: str):
    raw = json.loads(Path(path).read_text())
    known = {f.name for f in fields(cls)} | set(cls.ALIASES)
    return cls(**{cls.ALIASES.get(k, k): v for k, v in raw.items() if k in known})


@dataclass(frozen=True)
class InterpolationConfig:
    neighbours: int = 10
    resolution: float = 0.5
    max_distance: float = 5.0
    power: float = 2.0
    weights: float = 2.0  # a constant factor: it cancels, but zero makes all nodes NoData
    method: Literal["idw", "idw_eps", "knn"] = "idw"
    r_min: float | None = None
    z_field: str = "z"
    classes: tuple[int, ...] | None = None
    smooth_sigma: float | None = None
    geoid_file: str | None = None
    geoid_radius: float = 2000.0
    geoid_crs: str = "epsg:4326"
    source_crs: str = "epsg:2180"
    missing: Literal["skip", "zero"] = "skip"  # zero: absent neighbours weigh in with value zero
    zero: Literal["node", "poison"] = "node"  # poison: one hit anywhere makes nodes with absent neighbours NoData
    leafsize: int = 10  # accepted, of no effect

    ALIASES = {"N": "neighbours", "sourceCrs": "source_crs", "geoidCrs": "geoid_crs", "z_field_name": "z_field"}

    def __post_init__(self):
        if not (1 <= self.neighbours and self.resolution > 0 and self.max_distance > 0 and self.weights >= 0):
            raise ValueError("neighbours, resolution and max_distance must be above zero, weights at least zero")
        if self.method not in ("idw", "idw_eps", "knn"):
            raise ValueError(f"unknown method {self.method}")

    @classmethod
    def load(cls, path: str) -> InterpolationConfig:
        raw = json.loads(Path(path).read_text())
        on = lambda k: str(raw.get(k, False)).lower() == "true"
        more = {
            "method": "knn" if on("knn_calculate") else "idw" if on("idw_numpy") else "idw_eps",
            "classes": tuple(raw.get("filter_classes") or ()) if on("filter_las") else None,
            "smooth_sigma": float(raw["smooth_level"]) if on("smooth_result") else None,
            "geoid_file": raw.get("geoid_correction_file") if on("geoid_correction") else None,
            "r_min": raw.get("r_min") if on("r_min_function") else None,
        }
        known = {f.name for f in fields(cls)} | set(cls.ALIASES)
        return cls(**({cls.ALIASES.get(k, k): v for k, v in raw.items() if k in known and k not in more} | more))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=4))


@dataclass(frozen=True)
class CompressionConfig:
    accuracy: float = 0.05
    block: int = 16
    decimal: int = 2
    dct_type: Literal[1, 2, 3] = 2
    force_crs: str = "epsg:2180"
    search: Literal["minimal", "bisect"] = "minimal"

    ALIASES = {"matrix": "block", "type_dct": "dct_type", "sourceCrs_force_declare": "force_crs"}

    def __post_init__(self):
        if not (self.accuracy > 0 and self.block >= 2 and 0 <= self.decimal <= 6 and self.dct_type in (1, 2, 3)):
            raise ValueError("accuracy above 0, block at least 2, decimal 0 to 6, dct_type 1 to 3")

    load = classmethod(_load)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=4))


def grid_name(base: str, cfg: InterpolationConfig) -> str:
    return f"{base}-N-{cfg.neighbours}-R-{cfg.resolution}-dist-{cfg.max_distance}"


def archive_name(base: str, cfg: CompressionConfig, crs: str, valid: bool) -> str:
    return f"{base}_N{cfg.block}_Acc{cfg.accuracy}_tdct{cfg.dct_type}_dec{cfg.decimal}_CRS{crs}_V{'T' if valid else 'F'}"


def crs_label(crs: str | None, fallback: str) -> str:
    """The EPSG number if there is one, else letters and digits, 20 at most."""
    crs = crs or fallback
    found = re.search(r"epsg\W*(\d+)", crs, re.I)
    return found[1] if found else re.sub(r"\W", "", crs)[:20]


def resolve(path: str, root: str) -> str:
    """Paths that begin with ./ lie below root."""
    return str(Path(root) / path[2:]) if path.startswith("./") else path
