"""Settings out of a TOML file. What it doesn't set has a default; what it sets has to be known, of the right kind and within bounds, else nothing is loaded."""

from __future__ import annotations

import math
import tomllib
from dataclasses import dataclass, field, fields
from zoneinfo import ZoneInfo



@dataclass(frozen=True)
class Settings:
    """A station, how its forecasts are collected, and how methods are tried and promoted."""

    latitude: float = field(default=34.2768, metadata={"section": "station", "low": -90, "high": 90})
    longitude: float = field(default=-117.1692, metadata={"section": "station", "low": -180, "high": 180})
    elevation_m: float = field(default=1400.0, metadata={"section": "station", "low": -500, "high": 9000})
    timezone: str = field(default="America/Los_Angeles", metadata={"section": "station"})
    max_forecast_age_hours: float = field(default=12.0, metadata={"section": "forecasts", "low": 0, "high": 240})
    min_hour_coverage: float = field(default=0.8, metadata={"section": "dataset", "low": 0, "high": 1})
    min_day_coverage: float = field(default=0.8, metadata={"section": "dataset", "low": 0, "high": 1})
    initial_train_days: int = field(default=10, metadata={"section": "backtest", "low": 1, "high": 3650})
    step_days: int = field(default=5, metadata={"section": "backtest", "low": 1, "high": 365})
    alpha: float = field(default=0.1, metadata={"section": "promotion", "low": 1e-6, "high": 0.5})
    live_gap_factor: float = field(default=1.5, metadata={"section": "promotion", "low": 1, "high": 100})
    min_live_n: int = field(default=24, metadata={"section": "promotion", "low": 1, "high": 1_000_000})
    lead_caps: dict[str, float] = field(default_factory=dict, metadata={"section": "forecasts", "low": 0, "high": 400})
    excluded: tuple[tuple[str, str], ...] = field(default=(), metadata={"section": "forecasts"})


def _number(name: str, value, spec, whole: bool):
    if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name}: not {'a whole' if whole else 'a finite'} number: {value!r}")
    if not spec["low"] <= value <= spec["high"]:
        raise ValueError(f"{name}: {value} isn't between {spec['low']} and {spec['high']}")
    return value if whole else float(value)


def loaded(path: str) -> Settings:
    """The settings of a file."""
    with open(path, "rb") as f:
        told = tomllib.load(f)
    known = {(f.metadata["section"], f.name): f for f in fields(Settings)}
    out = {}
    for section, table in told.items():
        if not isinstance(table, dict):
            raise ValueError(f"{section}: not a section")
        for name, value in table.items():
            spec = known.get((section, name))
            if spec is None:
                raise ValueError(f"{section}.{name}: unknown")
            if spec.type == "str":
                if not isinstance(value, str):
                    raise ValueError(f"{name}: not text")
                ZoneInfo(value)
                out[name] = value
            elif name == "lead_caps":
                out[name] = {str(k): _number(f"{name}.{k}", v, spec.metadata, False) for k, v in value.items()}
            elif name == "excluded":
                if any(not isinstance(p, list) or len(p) != 2 for p in value):
                    raise ValueError(f"{name}: not pairs of a source and a variable")
                out[name] = tuple((str(a), str(b)) for a, b in value)
            else:
                out[name] = _number(name, value, spec.metadata, spec.type == "int")
    return Settings(**out)
