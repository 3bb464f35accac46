"""Settings with dotted keys."""

from __future__ import annotations

import copy

from .errors import SettingsError

DEFAULTS = {
    "time": {"store_tz": "UTC", "timestamp_tolerance": "4min", "origin_tolerance": "5min", "freq_tolerance": "2min"},
    "quality": {"gross_value": {"lower": -15.0, "upper": 39.0}, "persistence": {"window": "60min", "min_records": 5}, "repetitions": {"max_n": 5}},
    "fill": {"max_interpolation": "3h", "max_model": "12h"},
    "import": {"min_records_per_station": 3},
}


class Settings:
    """A nested dictionary read and written by keys such as ``quality.repetitions.max_n``."""

    def __init__(self):
        self._values = copy.deepcopy(DEFAULTS)

    def _holder(self, key: str) -> tuple[dict, str]:
        *path, last = key.split(".")
        at = self._values
        for p in path:
            at = at.get(p) if isinstance(at, dict) else None
        if not isinstance(at, dict) or last not in at:
            raise SettingsError(f"no setting {key!r}")
        return at, last

    def get(self, key: str):
        at, last = self._holder(key)
        return copy.deepcopy(at[last])

    def set(self, key: str, value) -> None:
        at, last = self._holder(key)
        if isinstance(at[last], dict):
            raise SettingsError(f"{key!r} is a group of settings")
        at[last] = value

    def reset(self, key: str | None = None) -> None:
        if key is None:
            self._values = copy.deepcopy(DEFAULTS)
            return
        at, last = self._holder(key)
        default = DEFAULTS
        for p in key.split("."):
            default = default[p]
        at[last] = copy.deepcopy(default)

    def to_dict(self) -> dict:
        return copy.deepcopy(self._values)
