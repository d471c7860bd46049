"""Settings of an index and its cache."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class Config:
    mode: str = "exact"
    update_every: int = 256
    num_levels: int = 5
    max_iterations: int = 1
    branching_factor: int = 10
    threshold_method: str = "topk"
    sample_size: int = 1000

    def __post_init__(self):
        if self.mode not in ("exact", "scan"):
            raise ValueError("mode is exact or scan")
        if self.mode == "scan" and self.num_levels not in (2, 3):
            raise ValueError("scan mode is for two or three levels")
        if min(self.update_every, self.num_levels, self.branching_factor, self.sample_size) < 1:
            raise ValueError("update_every, num_levels, branching_factor and sample_size are at least 1")
        if self.threshold_method not in ("topk", "sample_max", "sample_mean_topk"):
            raise ValueError("threshold_method is topk, sample_max or sample_mean_topk")

    @classmethod
    def from_dict(cls, given: dict[str, Any]) -> Config:
        known = {f.name for f in fields(cls)}
        if unknown := set(given) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**given)

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        return cls.from_dict(read_yaml(path))


def read_yaml(path: str) -> dict[str, Any]:
    """A YAML mapping; an empty file is {}.  Flat files of scalars are read without PyYAML."""
    with open(path) as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        pairs = (line.split("#")[0].partition(":") for line in text.splitlines())
        return {k.strip(): _scalar(v.strip()) for k, _, v in pairs if k.strip()}
    return yaml.safe_load(text) or {}


def _scalar(text: str) -> Any:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "": None}.get(text.lower(), text.strip("'\""))


def auto_depth(n: int, bf: int) -> int:
    return max(1, math.ceil(math.log(n) / math.log(bf))) if n > 1 and bf > 1 else 1
