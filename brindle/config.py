"""Settings of the review process, from a JSON file or a mapping, and the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from brindle.functions.vocab import CRITERIA, WEIGHTS

PREFIX = "BRINDLE_"


@dataclass(frozen=True)
class Settings:
    """store: folder of the evidence store; skills: folder of skill files; weights: of the rubric's criteria."""

    store: str = "store"
    skills: str = "skills"
    reviewer: str = "local_user"
    provider: str = "mock"
    model: str = "mock"
    critic: bool = False
    validation_fraction: float = 0.3
    seed: int = 13
    least_gain: float = 0.10
    most_grounding_drop: float = 0.0
    weights: Mapping[str, str] = field(default_factory=lambda: dict(WEIGHTS))

    def __post_init__(self):
        if set(self.weights) != set(CRITERIA) or abs(sum(map(float, self.weights.values())) - 1) > 1e-6:
            raise ValueError("weights must cover all criteria and sum to 1")
        if not 0 <= self.validation_fraction <= 1:
            raise ValueError("validation_fraction must be from 0 to 1")


def load(values: Mapping | None = None, environ: Mapping[str, str] | None = None) -> Settings:
    """Settings from `values`; a variable BRINDLE_<NAME> wins. Unknown names are refused."""
    environ = os.environ if environ is None else environ
    settings = Settings(**(values or {}))
    for f in fields(Settings):
        text = environ.get(PREFIX + f.name.upper(), "")
        if text and f.name != "weights":
            kind = type(getattr(settings, f.name))
            settings = replace(settings, **{f.name: text.lower() in ("1", "true", "yes") if kind is bool else kind(text)})
    return settings


def load_file(path: str, environ: Mapping[str, str] | None = None) -> Settings:
    """Settings from a JSON object in a file on the driver."""
    with open(path, encoding="utf-8") as file:
        return load(json.load(file), environ)
