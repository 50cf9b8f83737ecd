"""Settings of a run, with defaults by entity type, validation and deep-merged overrides."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field, fields
from typing import Any

CHANNELS = ("email", "phone", "website", "location", "taxonomy")
SIGNALS = ("shared_email", "shared_phone", "shared_domain", "shared_taxonomy", "shared_address", "shared_identifier")


@dataclass(frozen=True)
class Blocking:
    similarity_threshold: float = 0.75
    max_candidates: int = 50
    channels: tuple[str, ...] = CHANNELS


@dataclass(frozen=True)
class Nlp:
    algorithm: str = "sequence_matcher"
    fuzzy_threshold: float = 0.88
    standalone_threshold: float = 0.94
    number_veto: bool = True


@dataclass(frozen=True)
class Ml:
    enabled: bool = False
    gate: float = 0.55


@dataclass(frozen=True)
class Scoring:
    weights: dict[str, float] = field(default_factory=dict)
    section_weights: dict[str, float] = field(default_factory=dict)
    duplicate_threshold: float = 0.82
    maybe_threshold: float = 0.68
    calibration: bool = True
    prior: float = -0.5
    calibration_version: str = "v1"


@dataclass(frozen=True)
class Mitigation:
    enabled: bool = False
    min_embedding_similarity: float = 0.65
    require_reason: bool = True
    min_reasons: int = 1


@dataclass(frozen=True)
class Clustering:
    max_iter: int = 20
    min_edge_weight: float = 0.0
    min_size: int = 2
    algorithm: str = "correlation_v1"


@dataclass(frozen=True)
class Metadata:
    team_id: str = "team"
    scope_id: str = "scope"
    entity_type: str = "organization"
    policy_version: str = "p1"
    model_version: str = "m1"


@dataclass(frozen=True)
class Config:
    metadata: Metadata = Metadata()
    blocking: Blocking = Blocking()
    nlp: Nlp = Nlp()
    ml: Ml = Ml()
    scoring: Scoring = Scoring()
    mitigation: Mitigation = Mitigation()
    clustering: Clustering = Clustering()
    strict: bool = True

    def __post_init__(self) -> None:
        unknown = set(self.blocking.channels) - set(CHANNELS)
        if unknown or not self.blocking.channels:
            raise ValueError(f"channels must be some of {CHANNELS}: {sorted(unknown) or 'none given'}")
        if self.metadata.entity_type not in ("organization", "service"):
            raise ValueError(f"unknown entity type: {self.metadata.entity_type}")
        if any(w < 0 or w > 0.6 for w in self.scoring.weights.values()) or set(self.scoring.weights) - set(SIGNALS):
            raise ValueError("signal weights must be known signals between 0 and 0.6")
        if self.scoring.section_weights and abs(sum(self.scoring.section_weights.values()) - 1) > 0.001:
            raise ValueError("section weights must add up to 1")
        if self.scoring.duplicate_threshold <= self.scoring.maybe_threshold:
            raise ValueError("the duplicate threshold must be above the maybe threshold")

    @staticmethod
    def default(entity_type: str = "organization") -> Config:
        if entity_type == "service":
            weights = dict(zip(SIGNALS, (0.16, 0.22, 0.04, 0.12, 0.34)))
            return Config(
                Metadata(entity_type="service"), Blocking(max_candidates=125), Nlp(fuzzy_threshold=0.86, standalone_threshold=0.92), Ml(gate=0.5),
                Scoring(weights, {"deterministic": 0.4, "nlp": 0.4, "ml": 0.2}, 0.70, 0.62, prior=-0.25),
            )
        weights = dict(zip(SIGNALS, (0.22, 0.20, 0.06, 0.08, 0.25, 0.25)))
        return Config(Metadata(entity_type=entity_type), scoring=Scoring(weights, {"deterministic": 0.45, "nlp": 0.35, "ml": 0.2}))

    @staticmethod
    def from_overrides(overrides: dict[str, Any] | None = None, entity_type: str = "organization") -> Config:
        """The defaults with nested overrides; an unknown key is an error."""
        return _merge(Config.default(entity_type), overrides or {}, "")


def _merge(base: Any, overrides: dict[str, Any], path: str) -> Any:
    known = {f.name for f in fields(base)}
    changed = {}
    for k, v in overrides.items():
        if k not in known:
            raise ValueError(f"unknown setting: {path}{k}")
        own = getattr(base, k)
        if dataclasses.is_dataclass(own) and isinstance(v, dict):
            changed[k] = _merge(own, v, f"{path}{k}.")
        elif isinstance(own, dict) and isinstance(v, dict):
            changed[k] = {**own, **v}
        else:
            changed[k] = tuple(v) if isinstance(own, tuple) else v
    return dataclasses.replace(base, **changed)
