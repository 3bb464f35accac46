"""Units as products of powers: a factor, an offset, and the exponents of base units.

``kg*m**-2``, ``mm/h``, ``kJ/m²``, ``inHg``: names or symbols, with a prefix if
they take one, joined by ``*``, ``·`` or a space, ``/``, powers by ``**``, ``^``
or superscripts, and parentheses.  Units are compatible if their exponents are
equal; percent, degree and radian are pure numbers.  A temperature on a scale
of its own keeps its offset only when it stands alone; in a product it is a
difference.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnitError

#: Base units: length, mass, time, temperature, current, amount, light.
BASE = ("meter", "kilogram", "second", "kelvin", "ampere", "mole", "candela")


@dataclass(frozen=True)
class Unit:
    """``value`` of this unit is ``value * factor + offset`` of base units."""

    factor: float = 1.0
    powers: tuple[int | float, ...] = (0,) * len(BASE)
    offset: float = 0.0

    def __mul__(self, other: Unit) -> Unit:
        return Unit(self.factor * other.factor, tuple(a + b for a, b in zip(self.powers, other.powers, strict=True)))

    def __pow__(self, n: float) -> Unit:
        return self if n == 1 else Unit(self.factor**n, tuple(a * n for a in self.powers))


def _dimension(**powers: int) -> tuple[int, ...]:
    names = dict(zip("m kg s K A mol cd".split(), range(len(BASE)), strict=True))
    out = [0] * len(BASE)
    for name, power in powers.items():
        out[names[name]] = power
    return tuple(out)


_NUMBER, _LENGTH, _MASS, _TIME, _HEAT = _dimension(), _dimension(m=1), _dimension(kg=1), _dimension(s=1), _dimension(K=1)
_FORCE, _PRESSURE, _ENERGY, _POWER = _dimension(kg=1, m=1, s=-2), _dimension(kg=1, m=-1, s=-2), _dimension(kg=1, m=2, s=-2), _dimension(kg=1, m=2, s=-3)

# Name -> (factor, exponents, symbols and other names, takes prefixes, offset).
_NAMED: dict[str, tuple] = {
    "meter": (1.0, _LENGTH, "m metre", True),
    "inch": (0.0254, _LENGTH, "in inches", False),
    "foot": (0.3048, _LENGTH, "ft feet", False),
    "yard": (0.9144, _LENGTH, "yd", False),
    "mile": (1609.344, _LENGTH, "mi", False),
    "nautical_mile": (1852.0, _LENGTH, "nmi", False),
    "hectare": (1e4, _dimension(m=2), "ha", False),
    "liter": (1e-3, _dimension(m=3), "l L litre", True),
    "gram": (1e-3, _MASS, "g", True),
    "pound": (0.45359237, _MASS, "lb", False),
    "tonne": (1000.0, _MASS, "t metric_ton", False),
    "second": (1.0, _TIME, "s sec", True),
    "minute": (60.0, _TIME, "min", False),
    "hour": (3600.0, _TIME, "h hr", False),
    "day": (86400.0, _TIME, "d", False),
    "week": (604800.0, _TIME, "", False),
    "year": (31557600.0, _TIME, "a yr", False),
    "hertz": (1.0, _dimension(s=-1), "Hz", True),
    "kelvin": (1.0, _HEAT, "K degK", True),
    "degree_Celsius": (1.0, _HEAT, "celsius degC °C degree_C", False, 273.15),
    "degree_Fahrenheit": (5 / 9, _HEAT, "fahrenheit degF °F degree_F", False, 459.67 * 5 / 9),
    "degree_Rankine": (5 / 9, _HEAT, "rankine degR °R", False),
    "delta_degree_Celsius": (1.0, _HEAT, "delta_degC", False),
    "ampere": (1.0, _dimension(A=1), "A amp", True),
    "volt": (1.0, _dimension(kg=1, m=2, s=-3, A=-1), "V", True),
    "mole": (1.0, _dimension(mol=1), "mol", True),
    "candela": (1.0, _dimension(cd=1), "cd", True),
    "lux": (1.0, _dimension(cd=1, m=-2), "lx", True),
    "newton": (1.0, _FORCE, "N", True),
    "pascal": (1.0, _PRESSURE, "Pa", True),
    "bar": (1e5, _PRESSURE, "", True),
    "standard_atmosphere": (101325.0, _PRESSURE, "atm atmosphere", False),
    "torr": (101325 / 760, _PRESSURE, "", False),
    "millimeter_Hg": (133.322387415, _PRESSURE, "mmHg", False),
    "inch_Hg": (3386.388640341, _PRESSURE, "inHg", False),
    "pound_force_per_square_inch": (6894.757293168361, _PRESSURE, "psi", False),
    "joule": (1.0, _ENERGY, "J", True),
    "calorie": (4.184, _ENERGY, "cal", True),
    "watt_hour": (3600.0, _ENERGY, "Wh", True),
    "watt": (1.0, _POWER, "W", True),
    "horsepower": (745.6998715822702, _POWER, "hp", False),
    "knot": (1852 / 3600, _dimension(m=1, s=-1), "kt kts kn", False),
    "mile_per_hour": (0.44704, _dimension(m=1, s=-1), "mph", False),
    "kilometer_per_hour": (1 / 3.6, _dimension(m=1, s=-1), "kph kmh", False),
    "dimensionless": (1.0, _NUMBER, "", False),
    "percent": (0.01, _NUMBER, "%", False),
    "permille": (0.001, _NUMBER, "‰", False),
    "ppm": (1e-6, _NUMBER, "parts_per_million", False),
    "radian": (1.0, _NUMBER, "rad", True),
    "degree": (math.pi / 180, _NUMBER, "deg ° degrees", False),
    "arcminute": (math.pi / 10800, _NUMBER, "", False),
    "arcsecond": (math.pi / 648000, _NUMBER, "", False),
}
# Prefixes by symbol and by name.
_PREFIXES = {"T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 10.0, "d": 0.1, "c": 1e-2, "m": 1e-3, "µ": 1e-6, "u": 1e-6, "n": 1e-9, "p": 1e-12}
_LONG = {"tera": 1e12, "giga": 1e9, "mega": 1e6, "kilo": 1e3, "hecto": 1e2, "deca": 10.0, "deci": 0.1, "centi": 1e-2, "milli": 1e-3, "micro": 1e-6, "nano": 1e-9, "pico": 1e-12}
_PREFIX_NAME = {s: n for s, f in _PREFIXES.items() for n, g in _LONG.items() if f == g}

# Standard unit and description of the known kinds of observation.
KINDS = {
    "temp": ("degree_Celsius", "2m - temperature"),
    "humidity": ("percent", "2m - relative humidity"),
    "radiation_temp": ("degree_Celsius", "2m - Black globe"),
    "pressure": ("hectopascal", "atmospheric pressure (at station)"),
    "pressure_at_sea_level": ("hectopascal", "atmospheric pressure (at sea level)"),
    "precip": ("millimeter/meter**2", "precipitation intensity"),
    "precip_sum": ("millimeter/meter**2", "Cummulated precipitation"),
    "wind_speed": ("meter/second", "wind speed"),
    "wind_gust": ("meter/second", "wind gust"),
    "wind_direction": ("degree", "wind direction"),
}

_SUPERSCRIPTS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")
_TOKEN = re.compile(r"\s*(?:(\*\*|\^)|([*·×])|(/|\bper\b)|([()])|([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|([^\W\d]\w*|[%‰°][A-Za-z]?))")


@cache
def _symbols() -> dict[str, str]:
    return {s: name for name, (_, _, other, *_) in _NAMED.items() for s in (name, *other.split())}


def _plain(name: str) -> Unit:
    factor, powers, *rest = _NAMED[name]
    return Unit(factor, powers, rest[2] if len(rest) > 2 else 0.0)


@cache
def _find(word: str) -> tuple[str, Unit]:
    """The unit that a word names, and its full name: a name, a symbol, either with a prefix, or a plural; then the same in lower case."""
    symbols = _symbols()
    if word in symbols:
        return symbols[word], _plain(symbols[word])
    for prefixes in (_LONG, _PREFIXES):
        for prefix in sorted(prefixes, key=len, reverse=True):
            rest = word[len(prefix) :]
            name = symbols.get(rest) if word.startswith(prefix) and rest else None
            # a long prefix goes with a name, a short one with a symbol
            if name and _NAMED[name][3] and (rest == name) == (prefixes is _LONG):
                full = (prefix if prefixes is _LONG else _PREFIX_NAME[prefix]) + name
                return full, replace(_plain(name), factor=_plain(name).factor * prefixes[prefix])
    if word.endswith("s") and len(word) > 3:
        try:
            return _find(word[:-1])
        except UnitError:
            pass
    low = {s.lower(): n for s, n in reversed(symbols.items())}
    if word.lower() in low:
        return low[word.lower()], _plain(low[word.lower()])
    if word.lower() != word:
        return _find(word.lower())
    # symbols that people write in small letters
    again = {p + s.lower(): p + s for s, n in symbols.items() if _NAMED[n][3] and s != s.lower() for p in _PREFIXES}
    if word in again:
        return _find(again[word])
    raise UnitError(f"unknown unit {word!r}")


class _Parser:
    """Products of powers, from left to right; a name, number or parenthesis right behind another is multiplied."""

    def __init__(self, text: str):
        text = re.sub(r"([⁻⁰¹²³⁴-⁹]+)", lambda m: "**" + m[1].translate(_SUPERSCRIPTS), text.strip())
        text = re.sub(r"(?<=[A-Za-z])(-?[23])(?![\w.])", r"**\1", text)  # m2, s-2
        text = re.sub(r"(?<=[A-Za-z])-1(?!\w)", "**-1", text)
        self.tokens, at = [], 0
        while at < len(text):
            match = _TOKEN.match(text, at)
            if not match or match.end() == at:
                if not text[at:].strip():
                    break
                raise UnitError(f"not a unit: {text!r}")
            self.tokens.append((match.lastindex, match[match.lastindex]))
            at = match.end()
        self.at, self.names = 0, {}

    def _next(self, *kinds: int) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in kinds:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> Unit:
        unit = self.product(1)
        if self.at < len(self.tokens):
            raise UnitError(f"not a unit: {self.tokens[self.at][1]!r} is out of place")
        return unit

    def product(self, sign: int) -> Unit:
        unit = self.power(sign)
        while self.at < len(self.tokens):
            kind, text = self.tokens[self.at]
            if kind in (2, 3):
                self.at += 1
            elif kind == 1 or text == ")":
                break
            below = kind == 3
            other = self.power(-sign if below else sign)
            unit = unit * (other ** (-1) if below else other)
        return unit

    def power(self, sign: int) -> Unit:
        start, before = self.at, dict(self.names)
        unit = self.single(sign)
        if self._next(1):
            exponent = self._next(5)
            if exponent is None:
                raise UnitError("a power needs a number")
            n = float(exponent)
            n, end = int(n) if n == int(n) else n, self.at
            self.at, self.names = start, before  # once more, to count the names with their power
            unit = self.single(sign * n) ** n
            self.at = end
        return unit

    def single(self, sign) -> Unit:
        if number := self._next(5):
            return Unit(float(number))
        if word := self._next(6):
            name, unit = _find(word)
            self.names[name] = self.names.get(name, 0) + sign
            return unit
        if self._next(4) == "(":
            unit = self.product(sign)
            if self._next(4) != ")":
                raise UnitError("a parenthesis is not closed")
            return unit
        raise UnitError("a name, a number or a parenthesis is wanted")


@cache
def _parsed(text: str) -> tuple[Unit, str]:
    if not text.strip():
        return _plain("dimensionless"), "dimensionless"
    parser = _Parser(text)
    unit = parser.whole()
    show = lambda name, n: name if n == 1 else f"{name}**{n}"
    above = [show(n, p) for n, p in parser.names.items() if p > 0]
    below = [show(n, -p) for n, p in parser.names.items() if p < 0]
    numbers = [x for k, x in parser.tokens if k == 5]
    if len(numbers) > sum(k == 1 for k, _ in parser.tokens):
        return unit, text.strip()  # with factors of its own
    name = "*".join(above) or ("1" if below else "dimensionless")
    return unit, name + "".join(f"/{b}" for b in below)


def parse(unit: str) -> Unit:
    """Factor, exponents and offset of a unit; UnitError if it is none."""
    return _parsed(unit)[0]


def canonical(unit: str) -> str:
    """A unit by full names, such as ``millimeter/hour``."""
    return _parsed(unit)[1]


def is_known(unit: str) -> bool:
    try:
        parse(unit)
    except UnitError:
        return False
    return True


def are_compatible(unit: str, other: str) -> bool:
    return parse(unit).powers == parse(other).powers


def compatible(unit: str) -> list[str]:
    """Named units, and standard ones of the known kinds, with the same exponents, in order of name."""
    names = {*_NAMED, *(u for u, _ in KINDS.values())}
    return sorted(u for u in names if are_compatible(u, unit))


def convert(value: Column, unit: str, to: str) -> Column:
    """``value`` in another unit with the same exponents."""
    a, b = parse(unit), parse(to)
    if a.powers != b.powers:
        raise UnitError(f"{unit!r} can't be turned into {to!r}: their dimensions differ")
    if canonical(unit) == canonical(to):
        return value
    if a.offset == b.offset == 0.0:
        return value * F.lit(a.factor / b.factor)
    return (value * F.lit(a.factor) + F.lit(a.offset - b.offset)) / F.lit(b.factor)
