"""Configuration: YAML with dotted overrides, and a table of rules over its settings and the commands' arguments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml

from geofold.functions.classes import CLASSES
from geofold.operators.embed import available
from geofold.operators.ml import KINDS


def load(path: str, overrides: list[str] | None = None) -> dict:
    """A YAML file with ``a.b=value`` overrides merged over it; values are read as YAML."""
    with open(path, encoding="utf-8") as f:
        out = yaml.safe_load(f) or {}
    for item in overrides or []:
        key, _, value = item.partition("=")
        at = out
        *parents, last = key.split(".")
        for p in parents:
            if not isinstance(at.get(p), dict):
                at[p] = {}
            at = at[p]
        at[last] = yaml.safe_load(value)
    return out


@dataclass(frozen=True)
class Rule:
    """A condition on a value and what to say where it fails; ``last`` if the topic's later rules need it."""

    ok: Callable[[Any], bool]
    say: str
    last: bool = False


def _listed(names) -> Rule:
    return Rule(lambda v: v in names, "{value!r} is none of " + " ".join(sorted(names)))


def _suffixed(suffixes: tuple[str, ...]) -> list[Rule]:
    return [
        Rule(lambda v: Path(v).exists(), "nothing at {value}", last=True),
        Rule(lambda v: Path(v).is_file(), "{value} is a folder", last=True),
        Rule(lambda v: str(v).lower().endswith(suffixes), "{value} ends in none of " + " ".join(suffixes)),
    ]


#: Rules by topic. A topic with a dotted place is a setting of the configuration, checked where it is given.
RULES: dict[str, list[Rule]] = {
    "existing_models.base_path": [Rule(lambda v: Path(v).exists(), "nothing at {value}")],
    "processing.device": [_listed(("auto", "cpu", "cuda", "mps"))],
    "gee_export.strategy": [_listed(("asset", "cloud_storage", "drive"))],
    "class_schema.classes": [Rule(lambda v: not v or set(v) == set(CLASSES), "its names are not those of the engine's schema")],
    "tiles.size": [Rule(lambda v: v > 0, "{value} is no size")],
    "tiles.overlap": [Rule(lambda v: v >= 0, "{value} is no overlap")],
    "model": [_listed(tuple(available()))],
    "classifier": [_listed(KINDS)],
    "ensemble": [_listed(("majority_vote", "probability_average", "weighted_vote"))],
    "fusion": [_listed(("confidence_weighted", "high_res_priority"))],
    "raster": _suffixed((".tif", ".tiff", ".geotiff")),
    "vector": _suffixed((".csv", ".geojson", ".gpkg", ".json", ".shp")),
    "weights": [  # (weights, number of rasters)
        Rule(lambda v: len(v[0]) == v[1], "there must be as many weights as rasters"),
        Rule(lambda v: min(v[0], default=0) >= 0, "a weight is below zero"),
        Rule(lambda v: sum(v[0]) > 0, "all weights together are not above zero"),
    ],
}
SECTIONS = ("project", "existing_models", "processing")


def broken(topic: str, value: Any) -> list[str]:
    """What the rules of a topic say against a value."""
    out = []
    for rule in RULES[topic]:
        if not rule.ok(value):
            out.append(f"{topic}: " + rule.say.format(value=value))
            if rule.last:
                break
    return out


def setting(config: dict | None, place: str) -> Any:
    """The value at a dotted place, or None."""
    at: Any = config
    for key in place.split("."):
        at = at.get(key) if isinstance(at, dict) else None
    return at


def check(config: dict | None) -> list[str]:
    """Sections that must be there, then every setting that has rules and is given."""
    out = [f"{s}: not in the configuration" for s in SECTIONS if setting(config, s) is None and s not in (config or {})]
    for place in RULES:
        if "." in place and (value := setting(config, place)) is not None:
            out += broken(place, value)
    return out


def report(found: list[str], kind: str = "problem") -> str:
    """One line for all that was found; empty for nothing."""
    return f"{len(found)} {kind}{'s' * (len(found) != 1)}: " + "; ".join(found) if found else ""
