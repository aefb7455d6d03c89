"""Settings of an analysis, checked when they are made, and their JSON form."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

AGGREGATES = ("mean", "median", "min", "max", "count")
RESIDUES = {"Y": ("Y",), "ST": ("S", "T")}


@dataclass(frozen=True)
class Params:
    """How evidence, null experiments and activities are made."""

    phospho_type: str = "ST"
    threshold: float | None = 1.0
    top_n: int | None = None
    greater: bool = True
    agg: str = "mean"
    min_evidence_size: int = 0
    reps: int = 150
    seed: int = 1
    alpha: float = 0.05
    m_from: str = "full"
    drop: str = "one"
    stratum: str = "compendia_class"

    def __post_init__(self):
        if self.phospho_type not in RESIDUES:
            raise ValueError(f"phospho_type must be one of {sorted(RESIDUES)}")
        if (self.threshold is None) == (self.top_n is None):
            raise ValueError("give either threshold or top_n")
        if self.agg not in AGGREGATES:
            raise ValueError(f"agg must be one of {AGGREGATES}")
        if self.top_n is not None and self.top_n < 1 or self.reps < 1 or self.min_evidence_size < 0:
            raise ValueError("top_n and reps must be positive, min_evidence_size not negative")
        if not 0 < self.alpha < 1:
            raise ValueError("alpha must lie between 0 and 1")
        if self.m_from not in ("full", "filtered") or self.drop not in ("one", "none"):
            raise ValueError("m_from is full or filtered, drop is one or none")
        if self.stratum not in ("compendia_class", "num_compendia"):
            raise ValueError("stratum is compendia_class or num_compendia")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Params:
        given, known = json.loads(text), {f.name for f in fields(cls)}
        if unknown := set(given) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**given)


def prefixed(columns: list[str], chosen: list[str] | None = None, prefix: str = "data:") -> dict[str, str]:
    """Old to new names of value columns: those with the prefix, or the chosen ones, which get it."""
    if chosen is None:
        return {c: c for c in columns if c.startswith(prefix)}
    if missing := [c for c in chosen if c not in columns and prefix + c not in columns]:
        raise ValueError(f"no such columns: {missing}")
    return {(c if c in columns else prefix + c): (c if c.startswith(prefix) else prefix + c) for c in chosen}


def renamed(columns: list[str], prefix: str, name: str) -> dict[str, str]:
    """Old to new names of columns with a prefix: the data set's name stands in its place."""
    return {c: name + c.removeprefix(prefix) for c in columns if c.startswith(prefix)}


def as_bool(text: str) -> bool:
    return str(text).strip().lower() in ("yes", "true", "t", "y", "1")
