"""Scoring configuration as frozen dataclasses; numbers are checked once on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

METHODS = ("raw", "zscore", "rank")
DIRECTIONS = ("higher_better", "lower_better", "ordinal")
# Columns holding dosage categories: only codes 0-3 score, on a scale of 3.
DOSAGE_COLUMNS = ("clinGen_hi_score", "clinGen_triplo_score")


def _finite(value: float, name: str) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number")


@dataclass(frozen=True)
class Evidence:
    column: str
    weight: float
    direction: str = "higher_better"
    ordinal_scale: float | None = None
    low_score_penalty: float = 0.0

    def __post_init__(self):
        _finite(self.weight, f"{self.column}.weight")
        _finite(self.low_score_penalty, f"{self.column}.low_score_penalty")
        if self.direction not in DIRECTIONS:
            raise ValueError(f"{self.column}: unknown direction {self.direction!r}")
        if self.ordinal_scale is not None:
            _finite(self.ordinal_scale, f"{self.column}.ordinal_scale")
        if self.column in DOSAGE_COLUMNS and self.low_score_penalty:
            raise ValueError(f"{self.column}: codes 0 and 1 are not negative evidence")

    @property
    def scale(self) -> float | None:
        return 3 if self.column in DOSAGE_COLUMNS else self.ordinal_scale


@dataclass(frozen=True)
class OrganPenalty:
    organs: tuple[str, ...] = ()
    expr_threshold: float = 9999.0
    per_organ_weight: float = 0.0
    cap: float = 0.0

    def __post_init__(self):
        for name in ("expr_threshold", "per_organ_weight", "cap"):
            _finite(getattr(self, name), f"penalty.{name}")


@dataclass(frozen=True)
class Tuning:
    grid: tuple[float, ...] = (0, 1, 2, 3)
    top_n: int = 10

    def __post_init__(self):
        for value in self.grid:
            _finite(value, "tuning.grid")
        if not any(value > 0 for value in self.grid):
            raise ValueError("the weight grid must contain a positive weight")


@dataclass(frozen=True)
class Consensus:
    evidence: tuple[Evidence, ...]
    normalize: str = "raw"
    penalty: OrganPenalty = field(default_factory=OrganPenalty)
    borda_missing: str = "median"
    recessive_factor: float = 1.0
    max_missing_rate: float = 0.5
    tuning: Tuning = field(default_factory=Tuning)

    def __post_init__(self):
        if self.normalize not in METHODS:
            raise ValueError(f"unknown normalize method: {self.normalize!r}")
        if self.borda_missing not in ("median", "zero"):
            raise ValueError("borda_missing must be median or zero")
        _finite(self.recessive_factor, "recessive_factor")
        if not 0 <= self.recessive_factor <= 1:
            raise ValueError("recessive_factor must be in [0, 1]")
        _finite(self.max_missing_rate, "max_missing_rate")
        if len({e.column for e in self.evidence}) != len(self.evidence):
            raise ValueError("an evidence column is listed twice")

    @property
    def weights(self) -> list[float]:
        return [float(e.weight) for e in self.evidence]

    def with_(self, **changes) -> "Consensus":
        return replace(self, **changes)


# The default screening profile.
SCREENING = Consensus(evidence=(
    Evidence("clinGen_hi_score", 3, "ordinal", 3),
    Evidence("gnomad_LOEUF", 2, "lower_better"),
    Evidence("gnomad_pLI", 2, "higher_better"),
))
MIN_UTR3_BP = 30
MODULE_BUDGET_BP = 4400
MODULE_BP = 300
