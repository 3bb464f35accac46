"""Conditions on rows as data frames take them, compiled from their syntax tree into columns.

``2 < a <= 5 & season in ["winter", "autumn"] | ~(b // 2 == 1)``: ``&`` and
``|`` bind as ``and`` and ``or`` do, comparisons may be chained, names in back
quotes may have any characters.  A missing value meets no comparison but ``!=``
and ``not in``.  Only what is listed here is compiled; nothing reaches SQL as
text.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import ArgumentError

_QUOTED = re.compile(r"(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]+`)")
_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log10": F.log10, "log1p": F.log1p, "expm1": F.expm1, "floor": F.floor, "ceil": F.ceil,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
}
_MISSING = {"isna": True, "isnull": True, "notna": False, "notnull": False}
_COMPARED: dict[type, Callable[[Column, Column], Column]] = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}


def _kind(dtype: S.DataType) -> str:
    if isinstance(dtype, S.StringType):
        return "text"
    if isinstance(dtype, (S.TimestampType, S.TimestampNTZType, S.DateType)):
        return "time"
    return "truth" if isinstance(dtype, S.BooleanType) else "number" if isinstance(dtype, S.NumericType) else "other"


class _Compiler:
    """A node gives (column, kind); kinds are text, number, time, truth, missing and other."""

    def __init__(self, df: DataFrame, names: dict[str, str]):
        self.columns = {f.name: (F.col(f"`{f.name.replace('`', '``')}`"), _kind(f.dataType)) for f in df.schema.fields}
        self.names = names

    def __call__(self, node: ast.AST) -> tuple[Column, str]:
        method = getattr(self, type(node).__name__, None)
        if method is None:
            raise ArgumentError(f"{type(node).__name__} has no place in a condition")
        return method(node)

    def truth(self, node: ast.AST) -> Column:
        column, kind = self(node)
        if kind not in ("truth", "missing"):
            raise ArgumentError(f"{ast.unparse(node)} is neither true nor false")
        return F.coalesce(column.cast("boolean"), F.lit(False))

    def number(self, node: ast.AST) -> Column:
        column, kind = self(node)
        if kind not in ("number", "truth"):
            raise ArgumentError(f"{ast.unparse(node)} is no number")
        return column.cast("double") if kind == "truth" else column

    def Name(self, node: ast.Name) -> tuple[Column, str]:
        name = self.names.get(node.id, node.id)
        if name not in self.columns:
            raise ArgumentError(f"name {name!r} is not defined; text stands in quotes")
        return self.columns[name]

    def Constant(self, node: ast.Constant) -> tuple[Column, str]:
        value = node.value
        if value is None:
            return F.lit(None), "missing"
        kind = {bool: "truth", int: "number", float: "number", str: "text"}.get(type(value))
        if kind is None:
            raise ArgumentError(f"{value!r} has no place in a condition")
        return F.lit(value), kind

    def BoolOp(self, node: ast.BoolOp) -> tuple[Column, str]:
        first, *others = (self.truth(v) for v in node.values)
        for other in others:
            first = first & other if isinstance(node.op, ast.And) else first | other
        return first, "truth"

    def UnaryOp(self, node: ast.UnaryOp) -> tuple[Column, str]:
        if isinstance(node.op, (ast.Not, ast.Invert)):
            return ~self.truth(node.operand), "truth"
        value = self.number(node.operand)
        return (-value if isinstance(node.op, ast.USub) else value), "number"

    def BinOp(self, node: ast.BinOp) -> tuple[Column, str]:
        if isinstance(node.op, ast.Add) and self(node.left)[1] == self(node.right)[1] == "text":
            return F.concat(self(node.left)[0], self(node.right)[0]), "text"
        a, b = self.number(node.left), self.number(node.right)
        x, y = a.cast("double"), b.cast("double")
        infinite = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))
        ratio = F.when(y != 0, F.try_divide(x, y)).when(y == 0, infinite)
        made = {ast.Add: lambda: x + y, ast.Sub: lambda: x - y, ast.Mult: lambda: x * y, ast.Div: lambda: ratio, ast.FloorDiv: lambda: F.when(y == 0, infinite).otherwise(F.floor(ratio).cast("double")), ast.Mod: lambda: F.when(y != 0, x - F.floor(F.try_divide(x, y)) * y), ast.Pow: lambda: F.pow(x, y)}.get(type(node.op))
        if made is None:
            raise ArgumentError(f"{type(node.op).__name__} has no place in a condition")
        return made(), "number"

    def Call(self, node: ast.Call) -> tuple[Column, str]:
        if isinstance(node.func, ast.Attribute) and node.func.attr in _MISSING and not node.args and not node.keywords:
            column, kind = self(node.func.value)
            missing = column.isNull() | F.isnan(column.cast("double")) if kind == "number" else column.isNull()
            return (missing if _MISSING[node.func.attr] else ~missing), "truth"
        if isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS and len(node.args) == 1 and not node.keywords:
            return _FUNCTIONS[node.func.id](self.number(node.args[0])), "number"
        raise ArgumentError(f"no function {ast.unparse(node.func)!r} in a condition")

    def Compare(self, node: ast.Compare) -> tuple[Column, str]:
        parts, left = [], node.left
        for op, right in zip(node.ops, node.comparators, strict=True):
            parts.append(self._member(left, op, right) if isinstance(right, (ast.List, ast.Tuple, ast.Set)) else self._compared(left, op, right))
            left = right
        whole = parts[0]
        for part in parts[1:]:
            whole = whole & part
        return whole, "truth"

    def _member(self, left: ast.AST, op: ast.cmpop, right: ast.List | ast.Tuple | ast.Set) -> Column:
        if not isinstance(op, (ast.In, ast.NotIn, ast.Eq, ast.NotEq)):
            raise ArgumentError("a list is compared by in, not in, == and != only")
        found = F.lit(False)
        for item in right.elts:
            found = found | self._compared(left, ast.Eq(), item)
        return found if isinstance(op, (ast.In, ast.Eq)) else ~found

    def _compared(self, left: ast.AST, op: ast.cmpop, right: ast.AST) -> Column:
        if type(op) not in _COMPARED:
            raise ArgumentError(f"{type(op).__name__} needs a list in a condition")
        (a, ka), (b, kb) = self(left), self(right)
        differs = isinstance(op, ast.NotEq)
        if "missing" in (ka, kb):
            return F.lit(differs)
        if {ka, kb} == {"time", "text"}:
            a, b = a.cast("timestamp"), b.cast("timestamp")
        elif {ka, kb} == {"truth", "number"}:
            a, b = a.cast("double"), b.cast("double")
        elif ka != kb:
            if not isinstance(op, (ast.Eq, ast.NotEq)):
                raise ArgumentError(f"{ast.unparse(left)} and {ast.unparse(right)} have no order")
            return F.lit(differs)  # a text is never equal to a number
        met = _COMPARED[type(op)](a, b)
        for x, kind in ((a, ka), (b, kb)):
            met = F.when(F.isnan(x.cast("double")), F.lit(differs)).otherwise(met) if kind == "number" else met
        return F.coalesce(met, F.lit(differs))


def condition(text: str, df: DataFrame) -> Column:
    """The condition ``text`` on the columns of ``df``; ArgumentError if it is none."""
    names: dict[str, str] = {}
    parts = _QUOTED.split(text)
    for i, part in enumerate(parts):
        if i % 2 == 0:
            parts[i] = re.sub(r"\|\|?", " or ", re.sub(r"&&?", " and ", part))
        elif part.startswith("`"):
            parts[i] = f"_quoted{len(names)}_"
            names[parts[i]] = part[1:-1]
    try:
        tree = ast.parse("".join(parts).strip(), mode="eval")
    except SyntaxError as e:
        raise ArgumentError(f"no condition: {text!r} ({e.msg})") from None
    return _Compiler(df, names).truth(tree.body)
