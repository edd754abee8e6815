"""Configuration files: YAML where a parser is installed, JSON anywhere."""

from __future__ import annotations

import json

#: What a configuration may leave out.
DEFAULTS = {
    "data": {"source": "csv", "path": "data/", "source_tz": "UTC", "timeframe": "15min", "start": None, "end": None, "cache_max_age_hours": 12},
    "costs": {"round_trip_points": 1.0},
    "walkforward": {"train_bars": 8000, "test_bars": 1500, "anchored": False, "max_folds": 24, "holdout_months": 12},
    "model": {"backend": None},
    "search": {"seed": 7, "warmup": 60, "elite_k": 25, "p_crossover": 0.25, "min_trades": 100, "min_folds": 3, "report_every": 10, "max_duplicate_tries": 400, "screen_folds": 6, "screen_z": 2.0},
    "output": {"dir": "results", "log_file": None},
}


def load(path: str | None) -> dict:
    own = {}
    if path:
        with open(path, encoding="utf-8") as f:
            if path.endswith(".json"):
                own = json.load(f)
            else:
                try:
                    import yaml
                except ImportError:
                    raise RuntimeError("no YAML parser is installed; give the configuration as JSON") from None
                own = yaml.safe_load(f) or {}
    unknown = set(own) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown sections {sorted(unknown)}; known: {sorted(DEFAULTS)}")
    return {k: v | (own.get(k) or {}) for k, v in DEFAULTS.items()}


def bars_needed(config: dict) -> int:
    """Bars below which a search isn't begun: a training window and three test windows."""
    w = config["walkforward"]
    return w["train_bars"] + 3 * w["test_bars"]
