"""Templates: how a file's columns become (name, obstype, datetime, value)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from zoneinfo import available_timezones

from pyspark.sql import SparkSession

from ..errors import TemplateError
from ..functions.units import is_known

#: Columns that the result uses; a raw column of such a name is renamed unless it is mapped.
RESERVED = ("name", "lat", "lon", "altitude", "lcz")


@dataclass(frozen=True)
class Template:
    """``obstypes`` maps a kind to its raw column, unit and description."""

    structure: str = "long"
    timezone: str = "UTC"
    datetime_column: str | None = None
    datetime_format: str | None = None
    date_column: str | None = None
    date_format: str | None = None
    time_column: str | None = None
    time_format: str | None = None
    name_column: str | None = None
    single_name: str = "dummy_station_name"
    obstypes: dict[str, tuple[str | None, str | None, str | None]] = field(default_factory=dict)
    meta_name_column: str | None = None
    meta_lat_column: str | None = None
    meta_lon_column: str | None = None
    meta_altitude_column: str | None = None
    meta_extra: tuple[str, ...] = ()

    def __post_init__(self):
        if self.structure not in ("long", "wide", "single_station"):
            raise TemplateError(f"unknown structure {self.structure!r}")
        if self.datetime_column is None and (self.date_column is None or self.time_column is None):
            raise TemplateError("neither a datetime column nor a date and a time column")
        if self.timezone not in available_timezones():
            raise TemplateError(f"unknown time zone {self.timezone!r}")
        if self.structure == "wide" and len(self.obstypes) != 1:
            raise TemplateError("a wide file holds one kind of observation")
        if self.structure == "long" and self.name_column is None:
            raise TemplateError("a long file needs a name column")
        for kind, (_, unit, _) in self.obstypes.items():
            if unit is not None and not is_known(unit):
                raise TemplateError(f"unknown unit {unit!r} of {kind}")

    def columns(self) -> list[str]:
        """Raw columns that the data file must have."""
        own = [self.datetime_column, self.date_column, self.time_column, self.name_column if self.structure == "long" else None]
        values = [] if self.structure == "wide" else [c for c, _, _ in self.obstypes.values()]
        return [c for c in [*own, *values] if c]

    @classmethod
    def build(cls, **options) -> Template:
        return cls(**options)

    @classmethod
    def from_dict(cls, data: dict) -> Template:
        """The template file's nested form."""
        obs, meta = data.get("data_related", {}), data.get("metadata_related", {})
        t = obs.get("timestamp", {})
        return cls(
            structure=obs.get("structure") or "long",
            timezone=t.get("timezone") or "UTC",
            **{k: t.get(k.replace("_format", "_fmt")) for k in ("datetime_column", "datetime_format", "date_column", "date_format", "time_column", "time_format")},
            name_column=obs.get("name_column"),
            single_name=data.get("single_station_name") or "dummy_station_name",
            obstypes={o["tlk_obstype"]: (o.get("columnname"), o.get("unit"), o.get("description")) for o in obs.get("obstype_mapping", [])},
            **{f"meta_{k}": meta.get(k) for k in ("name_column", "lat_column", "lon_column", "altitude_column")},
            meta_extra=tuple(meta.get("columns_to_include") or ()),
        )

    def to_dict(self) -> dict:
        keys = ("datetime_column", "datetime_format", "date_column", "date_format", "time_column", "time_format")
        return {
            "data_related": {
                "structure": self.structure,
                "timestamp": {k.replace("_format", "_fmt"): getattr(self, k) for k in keys} | {"timezone": self.timezone},
                "name_column": self.name_column,
                "obstype_mapping": [{"tlk_obstype": k, "columnname": c, "unit": u, "description": d} for k, (c, u, d) in self.obstypes.items()],
            },
            "metadata_related": {k: getattr(self, f"meta_{k}") for k in ("name_column", "lat_column", "lon_column", "altitude_column")} | {"columns_to_include": list(self.meta_extra)},
            "single_station_name": self.single_name,
        }

    @classmethod
    def read(cls, path: str) -> Template:
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Template:
        """A template file from any store that Spark reads."""
        rows = spark.read.text(path, wholetext=True).limit(2).collect()
        if len(rows) != 1:
            raise TemplateError(f"no single template file at {path}")
        return cls.from_dict(json.loads(rows[0][0]))

    def write(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=2, ensure_ascii=False), encoding="utf-8")
