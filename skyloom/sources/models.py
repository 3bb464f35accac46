"""Models: the kinds of observation that a model's exports have, each from a band and its unit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError, MissingError, UnitError
from ..functions import units
from ..functions import values as V
from .readers import Raster, sampled

MODEL = ["name", "obstype", "modelname", "modelvariable", "datetime", "value"]


@dataclass(frozen=True)
class Kind:
    """Where a kind comes from: one band, or two that are the components of a vector; their unit, and the one it is turned into."""

    bands: tuple[str, ...]
    unit: str
    standard: str
    description: str = ""


class Model:
    """A model by name, its grid, and a checked table of kinds."""

    def __init__(self, name: str, raster: Raster):
        if not name:
            raise ArgumentError("a model needs a name")
        self.name, self.raster = name, raster
        self.kinds: dict[str, Kind] = {}

    def _add(self, name: str, kind: Kind) -> Model:
        if not name or not all(kind.bands):
            raise ArgumentError("a kind and its bands need names")
        if not units.are_compatible(kind.unit, kind.standard):
            raise UnitError(f"{name!r}: {kind.unit!r} can't be turned into {kind.standard!r}")
        if self.kinds.get(name, kind) != kind:
            raise ArgumentError(f"model {self.name!r} has {name!r} from {self.kinds[name]} already")
        self.kinds[name] = kind
        return self

    def add(self, name: str, band: str, unit: str, standard: str | None = None, description: str = "") -> Model:
        """A kind from a band; one that isn't known needs a ``standard`` unit.  The same again is fine, another of that name raises."""
        known = units.KINDS.get(name)
        if known is None and standard is None:
            raise ArgumentError(f"no kind {name!r}: give its standard unit")
        return self._add(name, Kind((band,), unit, standard or known[0], description or (known[1] if known else "")))

    def add_vector(self, name: str, u: str, v: str, unit: str, standard: str = "meter/second") -> Model:
        """A vector from its eastward and northward bands; it is sampled as the kinds ``name``_speed and ``name``_direction."""
        if u == v:
            raise ArgumentError("a vector needs two bands")
        return self._add(name, Kind((u, v), unit, standard))

    def chosen(self, kinds: list[str] | None = None) -> dict[str, Kind]:
        """The kinds asked for (all, if none are named)."""
        if unknown := sorted(set(kinds or []) - set(self.kinds)):
            raise MissingError(f"model {self.name!r} has no {', '.join(unknown)}")
        return {k: self.kinds[k] for k in (self.kinds if kinds is None else kinds)}

    def bands(self, kinds: list[str] | None = None) -> list[str]:
        return sorted({b for k in self.chosen(kinds).values() for b in k.bands})

    def table(self) -> list[tuple[str, str, str, str, str]]:
        """Rows (kind, bands, their unit, standard unit, description), by kind."""
        return [(name, "+".join(k.bands), k.unit, k.standard, k.description) for name, k in sorted(self.kinds.items())]

    def sample(self, grid: DataFrame, stations: DataFrame, start: str, end: str, kinds: list[str] | None = None, day_column: str | None = None) -> DataFrame:
        """Model rows of the cells that hold the stations, as ``readers.sample_model`` gives them, vectors included.

        Only the bands of the kinds asked for are read.  Of a band's repeated
        values in a cell, a vector takes the largest.  A vector that lacks a
        component has no rows; one of length 0 has no direction (null).
        """
        wanted = self.chosen(kinds)
        found = sampled(grid, self.raster, placed(stations), self.bands(kinds), start, end, day_column)
        parts = []
        plain = {name: k for name, k in wanted.items() if len(k.bands) == 1}
        if plain:
            each = [F.when(F.col("band") == k.bands[0], _row(name, k.bands[0], units.convert(F.col("value"), k.unit, k.standard))) for name, k in plain.items()]
            parts.append(found.select("name", "time", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x")))
        for name, k in wanted.items():
            if len(k.bands) == 2:
                u, v = (F.max(F.when(F.col("band") == b, F.col("value"))).alias(c) for b, c in zip(k.bands, "uv", strict=True))
                both = found.where(F.col("band").isin(*k.bands)).groupBy("name", "time").agg(u, v).where("u IS NOT NULL AND v IS NOT NULL")
                made = F.array(_row(f"{name}_speed", "+".join(k.bands), units.convert(V.amplitude(F.col("u"), F.col("v")), k.unit, k.standard)), _row(f"{name}_direction", "+".join(k.bands), V.direction(F.col("u"), F.col("v"))))
                parts.append(both.select("name", "time", F.explode(made).alias("x")))
        if not parts:
            raise MissingError(f"model {self.name!r} has no kinds")
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return rows.select("name", "x.obstype", F.lit(self.name).alias("modelname"), "x.modelvariable", F.col("time").alias("datetime"), "x.value")


def _row(kind: str, band: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("obstype"), F.lit(band).alias("modelvariable"), value.cast("double").alias("value"))


def placed(stations: DataFrame) -> DataFrame:
    """The stations that have coordinates; raises where the columns are missing or no station has any."""
    if missing := [c for c in ("name", "lat", "lon") if c not in stations.columns]:
        raise MissingError(f"stations have no column {', '.join(missing)}")
    at = stations.dropna(subset=["lat", "lon"])
    if at.isEmpty():
        raise MissingError("no station has coordinates")
    return at
