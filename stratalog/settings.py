"""Settings in layers: defaults, pyproject's [tool.stratalog], .stratalog.toml, then STRATALOG_* of the environment."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from .functions.scalars import parse_duration
from .operators.risk import WEIGHTS
from .operators.secret_rules import RULES, Rule, RuleError, rules_with

FILE = ".stratalog.toml"
PREFIX = "STRATALOG_"


class SettingsError(ValueError):
    """A setting that can't be used; the message names the layer and the key."""


@dataclass(frozen=True)
class Step:
    """An operator and its options; in texts of a rite's step, {source} stands for the source at hand."""

    operator: str
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Settings:
    watch_seconds: float = 2.0
    exclude: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = RULES
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    gate: dict = field(default_factory=lambda: {"secrets": "any"})
    recipes: dict[str, Step] = field(default_factory=dict)
    rites: dict[str, tuple[Step, ...]] = field(default_factory=dict)


def _number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def _texts(x) -> bool:
    return isinstance(x, list) and all(isinstance(v, str) for v in x)


def _duration(x) -> bool:
    try:
        return isinstance(x, str) and parse_duration(x) >= 0
    except ValueError:
        return False


#: What a gate checks, whether a value will do, and what it should be.
GATE = {
    "secrets": (lambda x: x in ("any", "high", "off"), "any, high or off"),
    "risk": (lambda x: _number(x) and 0 <= x <= 1, "a number from 0 to 1"),
    "advisories": (lambda x: x in ("any", "off"), "any or off"),
    "stale": (_duration, "an age like 365d"),
    "skills": (_texts, "a list of folders"),
}


def layers(root: Path) -> list[tuple[str, dict]]:
    """(name, table) of the files that hold settings, the weakest first."""
    out = []
    for name, keys in (("pyproject.toml", ("tool", "stratalog")), (FILE, ())):
        if not (root / name).is_file():
            continue
        try:
            table = tomllib.loads((root / name).read_text(encoding="utf-8"))
        except tomllib.TOMLDecodeError as error:
            raise SettingsError(f"{name}: {error}") from error
        for k in keys:
            table = table.get(k, {})
        out.append((name, table))
    return out


def _table(where: str, table: dict, key: str) -> dict:
    found = table.get(key, {})
    if not isinstance(found, dict):
        raise SettingsError(f"{where}: {key} is a table")
    return found


def _step(where: str, spec) -> Step:
    if not isinstance(spec, dict) or not isinstance(spec.get("operator"), str):
        raise SettingsError(f"{where}: an operator is needed")
    return Step(spec["operator"], {k: v for k, v in spec.items() if k != "operator"})


def load(root: Path, env: dict[str, str]) -> Settings:
    """The settings that hold in a folder."""
    seconds, exclude, custom = Settings.watch_seconds, [], {}
    weights, gate, recipes, rites = dict(WEIGHTS), {}, {}, {}
    for where, table in layers(root):
        seconds = table.get("watch_seconds", seconds)
        if not _texts(found := table.get("exclude", exclude)):
            raise SettingsError(f"{where}: exclude is a list of patterns")
        exclude = found
        for name, spec in _table(where, table, "rules").items():
            if not isinstance(spec, dict):
                raise SettingsError(f"{where}: rule {name} is a table")
            custom[name] = spec
        for name, value in _table(where, table, "weights").items():
            if name not in WEIGHTS or not _number(value) or value < 0:
                raise SettingsError(f"{where}: weight {name} is none of {', '.join(WEIGHTS)}, or no number from 0 on")
            weights[name] = float(value)
        for name, value in _table(where, table, "gate").items():
            if name not in GATE or not GATE[name][0](value):
                raise SettingsError(f"{where}: gate {name} is {GATE[name][1] if name in GATE else 'unknown'}")
            gate[name] = value
        recipes |= {name: _step(f"{where}: recipe {name}", spec) for name, spec in _table(where, table, "recipes").items()}
        for name, spec in _table(where, table, "rites").items():
            steps = spec.get("steps") if isinstance(spec, dict) else None
            if not steps:
                raise SettingsError(f"{where}: rite {name} has no steps")
            rites[name] = tuple(_step(f"{where}: rite {name}", s) for s in steps)
    if not sum(weights.values()):
        raise SettingsError("the weights are all 0")
    seconds = env.get(f"{PREFIX}WATCH_SECONDS", seconds)
    exclude = env[f"{PREFIX}EXCLUDE"].split(",") if env.get(f"{PREFIX}EXCLUDE") else exclude
    try:
        rules, seconds = rules_with(custom), float(seconds)
    except (RuleError, ValueError) as error:
        raise SettingsError(str(error)) from error
    return Settings(seconds, tuple(exclude), rules, weights, gate or {"secrets": "any"}, recipes, rites)
