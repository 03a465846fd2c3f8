"""Reproducible configuration: one specification of every setting, from which defaults, checks, merging and the hash follow."""

from __future__ import annotations

import hashlib
import json
from copy import deepcopy
from dataclasses import dataclass
from typing import Any

SCHEMA_VERSION = "0.7.0"
#: Documents of these versions can be read.
SUPPORTED_VERSIONS = ("0.2.0", "0.3.0", "0.4.0", "0.5.0", "0.6.0", "0.7.0")


@dataclass(frozen=True)
class Setting:
    """A setting's default, and what it may hold: a range, choices, a table of weights, or a list of either."""

    default: Any
    low: float | None = None
    high: float | None = None
    choices: tuple = ()

    def faults(self, name: str, value: Any) -> list[str]:  # noqa: ANN401
        """What is wrong with a value."""
        if isinstance(self.default, bool):
            return [] if isinstance(value, bool) else [f"{name} must be true or false"]
        if isinstance(self.default, dict):
            known = [f"{name}.{k} is unknown" for k in value if k not in self.default] if isinstance(value, dict) else [f"{name} must be a table"]
            return known or [x for k, v in value.items() for x in Setting(self.default[k], self.low, self.high).faults(f"{name}.{k}", v)]
        if isinstance(self.default, list):
            if not isinstance(value, list) or not 1 <= len(value) <= max(4, len(self.default)):
                return [f"{name} must be a list"]
            return [x for v in value for x in Setting(self.default[0], self.low, self.high, self.choices).faults(name, v)]
        if self.choices:
            return [] if value in self.choices else [f"{name} must be one of {', '.join(map(str, self.choices))}"]
        if isinstance(value, bool) or not isinstance(value, (int, float)) or isinstance(self.default, int) and value != int(value):
            return [f"{name} must be a {'whole ' * isinstance(self.default, int)}number"]
        return [] if self.low is None or self.low <= value <= self.high else [f"{name} must lie between {self.low} and {self.high}"]


_KERNELS = ("slic", "watershed", "felzenszwalb")
#: Every setting. Defaults, ranges and choices are fixed values, so that results are comparable with published ones.
SETTINGS: dict[str, Setting] = {
    "maxImagePixels": Setting(786_432, 4096, 2_000_000),
    "groupingMethod": Setting("slic", choices=_KERNELS),
    "segmentationStrategy": Setting("slic", choices=_KERNELS),
    "hierarchyMethod": Setting("global_energy_merge_tree", choices=("global_energy_merge_tree",)),
    "maxAgglomerationIterations": Setting(2048, 1, 20_000),
    "mergeEnergyThreshold": Setting(0.05, -10, 10),
    "mergeEnergyWeights": Setting({"distortion": 1.0, "rate": 0.06, "boundary": 0.45, "shape": 0.18, "complexity": 0.12}, 0, 10),
    "derivedCutTargetFractions": Setting({"region": 0.50, "composite": 0.25, "entity": 0.10}, 0.01, 1),
    "scaleLevels": Setting([1, 2, 4, 8], 1, 8),
    "slicSegments": Setting(72, 8, 180),
    "slicCompactness": Setting(10.0, 0.1, 50),
    "minimumRegionPixels": Setting(12, 1, 500),
    "maxInitialSegments": Setting(320, 16, 500),
    "graphK": Setting(3, 1, 12),
    "featureWeights": Setting({"gradient": 0.35, "variance": 0.20, "edge": 0.25, "texture": 0.20}, 0, 10),
    "groupingWeights": Setting({"space": 0.16, "color": 0.25, "brightness": 0.12, "texture": 0.13, "gradient": 0.12, "shape": 0.12, "boundary": 0.10}, 0, 10),
    "edgeBarrierThreshold": Setting(0.70, 0, 1),
    "maxEntityAreaFraction": Setting(0.72, 0.1, 1),
    "complexityMergePenalty": Setting(0.35, 0, 0.9),
    "shapeWeights": Setting({"compactness": 0.25, "orientation": 0.20, "hu": 0.55}, 0, 10),
    "runScaleConsistency": Setting(True),
    "maxConsistencyPixels": Setting(786_432, 4096, 1_500_000),
    "crossScaleOverlapThreshold": Setting(0.20, 0.01, 1),
    "labDeltaESigma": Setting(22.0, 1, 100),
    "boundaryGradientPercentile": Setting(99.0, 50, 100),
    "topology": Setting("4-neighbour", choices=("4-neighbour",)),
    "runParameterSensitivity": Setting(False),
    "sensitivityVariantLimit": Setting(5, 1, 5),
    "reconstructionProfile": Setting("balanced", choices=("fast", "balanced", "accurate")),
    "appearanceModelCandidates": Setting(["constant", "affine", "quadratic"], choices=("constant", "affine", "quadratic")),
    "modelPenalty": Setting(0.00045, 0, 0.1),
    "boundaryLeakagePenalty": Setting(0.00015, 0, 0.1),
    "residualEnabled": Setting(True),
    "residualQuantization": Setting(4, 1, 32),
    "residualBudgetBytes": Setting(196_608, 0, 2_000_000),
    "rateDistortionLambda": Setting(0.0015, 0, 1),
    "compareSegmentationBaselines": Setting(False),
}
DEFAULTS: dict[str, Any] = {name: s.default for name, s in SETTINGS.items()}
#: Pixels that a residual considers at most, and the bytes of an upload: fixed limits outside the configuration.
RESIDUAL_CANDIDATES, MAX_UPLOAD_BYTES = 131_072, 32 << 20


def faults(raw: dict[str, Any]) -> list[str]:
    """What is wrong with the settings that raw names; names without a specification pass through."""
    return [x for name, value in raw.items() if name in SETTINGS for x in SETTINGS[name].faults(name, value)]


def resolve(raw: dict[str, Any] | None = None, check: bool = True) -> dict[str, Any]:
    """All settings with raw's in their place: tables keep the weights that raw does not name, scales ascend from 1."""
    raw = raw or {}
    if check and (wrong := faults(raw)):
        raise ValueError("; ".join(wrong))
    merged = lambda old, new: old | new if isinstance(old, dict) and isinstance(new, dict) else new
    out = {name: merged(deepcopy(s.default), raw.get(name, deepcopy(s.default))) for name, s in SETTINGS.items()}
    out |= {name: value for name, value in raw.items() if name not in SETTINGS}
    return out | {"scaleLevels": sorted({1, *(max(int(x), 1) for x in out["scaleLevels"])})}


#: One spelling of any document: sorted names, no spaces, ASCII.
CANONICAL = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def canonical_json(value: Any) -> str:  # noqa: ANN401
    return CANONICAL.encode(value)


def config_hash(config: dict[str, Any]) -> str:
    """The first 16 hexadecimal digits of the SHA-256 of the configuration's canonical spelling."""
    digest = hashlib.sha256()
    for piece in CANONICAL.iterencode(config):
        digest.update(piece.encode("ascii"))
    return digest.hexdigest()[:16]
