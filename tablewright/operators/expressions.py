"""Conditions and derived columns of requests, as trees of plain values that become columns; nothing beyond a fixed set of forms is taken, and no text is ever evaluated.

A tree is {"column": name}, {"value": a number, text, boolean or null}, or {"op": name, "args": [trees]}. Types are checked against the table before anything runs: comparisons need two numbers, two texts, two
booleans or two times (a text counts as a time beside one), arithmetic needs numbers, ``and``, ``or`` and ``not`` need conditions. Comparisons with null are null, so such rows don't pass; division by zero gives null.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.plans.errors import BadRequest

COMPARISONS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))}
TEXTS = {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}
#: Parts of a tree, and the depth to which they nest.
MOST_PARTS, MOST_DEPTH = 1000, 50


def _kind(data: T.DataType) -> str:
    if isinstance(data, T.BooleanType):
        return "condition"
    if isinstance(data, T.NumericType):
        return "number"
    if isinstance(data, T.StringType):
        return "text"
    if isinstance(data, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return data.simpleString()


class _Tree:
    """Compiles one tree against a table's columns; each part gives a column and its kind."""

    def __init__(self, kinds: dict[str, str]):
        self.kinds, self.parts = kinds, 0

    def of(self, tree: object, depth: int = 0) -> tuple[Column, str]:
        self.parts += 1
        if self.parts > MOST_PARTS or depth > MOST_DEPTH:
            raise BadRequest(f"an expression has {MOST_PARTS} parts and {MOST_DEPTH} levels at most")
        if not isinstance(tree, dict):
            raise BadRequest(f"no expression: {tree!r}")
        if tree.keys() == {"column"}:
            if tree["column"] not in self.kinds:
                raise BadRequest(f"the table has no column {tree['column']!r}")
            return F.col("`" + tree["column"].replace("`", "``") + "`"), self.kinds[tree["column"]]
        if tree.keys() == {"value"}:
            return self._value(tree["value"])
        if tree.keys() != {"op", "args"} or not isinstance(tree["op"], str) or not isinstance(tree["args"], (list, tuple)):
            raise BadRequest(f"no expression: {tree!r}")
        return self._operation(tree["op"], [self.of(a, depth + 1) for a in tree["args"]])

    @staticmethod
    def _value(value: object) -> tuple[Column, str]:
        for kind, name in ((bool, "condition"), ((int, float), "number"), (str, "text"), (datetime, "time"), (type(None), "null")):
            if isinstance(value, kind):
                if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**63:
                    raise BadRequest(f"{value} is beyond 64 bits")
                return F.lit(value), name
        raise BadRequest(f"no value of an expression: {value!r}")

    def _operation(self, op: object, args: list[tuple[Column, str]]) -> tuple[Column, str]:
        columns, kinds = [c for c, _ in args], [k for _, k in args]

        def need(n: int, *allowed: str) -> None:
            if n >= 0 and len(args) != n or n < 0 and len(args) < -n or any(k not in (*allowed, "null") for k in kinds if allowed):
                raise BadRequest(f"{op} does not take {', '.join(kinds) or 'nothing'}")

        if op in ("and", "or"):
            need(-1, "condition")
            out = columns[0].cast("boolean")
            for c in columns[1:]:
                out = out & c.cast("boolean") if op == "and" else out | c.cast("boolean")
            return out, "condition"
        if op == "not":
            need(1, "condition")
            return ~columns[0].cast("boolean"), "condition"
        if op == "is_null":
            need(1)
            return columns[0].isNull(), "condition"
        if op in COMPARISONS:
            need(2)
            a, b = self._alike(op, args)
            return COMPARISONS[op](a, b), "condition"
        if op == "in":
            need(-2)
            first, out = args[0], None
            for other in args[1:]:
                a, b = self._alike(op, [first, other])
                out = a == b if out is None else out | (a == b)
            return out, "condition"
        if op in TEXTS:
            need(2, "text")
            return TEXTS[op](*(c.cast("string") for c in columns)), "condition"
        if op == "length":
            need(1, "text")
            return F.char_length(columns[0].cast("string")), "number"
        if op in ARITHMETIC:
            need(2, "number")
            return ARITHMETIC[op](*(c.cast("double") if k == "null" else c for c, k in args)), "number"
        raise BadRequest(f"unknown operation {op!r} of an expression")

    @staticmethod
    def _alike(op: object, args: list[tuple[Column, str]]) -> tuple[Column, Column]:
        (a, left), (b, right) = args
        if {left, right} == {"time", "text"}:
            return (a.try_cast("timestamp_ntz"), b) if left == "text" else (a, b.try_cast("timestamp_ntz"))
        if "null" not in (left, right) and left != right or not {left, right} <= {"number", "text", "condition", "time", "null"}:
            raise BadRequest(f"{op} does not compare {left} with {right}")
        return a, b


def _kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: _kind(f.dataType) for f in df.schema.fields}


def derived(df: DataFrame, columns: Sequence[dict]) -> DataFrame:
    """``df`` with new columns, each {"name", "expression"}; later ones may use earlier ones. Names must be new."""
    for one in columns:
        if not isinstance(one, dict) or one.keys() != {"name", "expression"} or not isinstance(one["name"], str) or not one["name"]:
            raise BadRequest(f"no derived column: {one!r}")
        if one["name"] in df.columns:
            raise BadRequest(f"the table has a column {one['name']} already")
        df = df.withColumn(one["name"], _Tree(_kinds(df)).of(one["expression"])[0])
    return df


def where(df: DataFrame, condition: dict) -> DataFrame:
    """The rows of ``df`` for which a condition is true."""
    column, kind = _Tree(_kinds(df)).of(condition)
    if kind != "condition":
        raise BadRequest(f"rows are chosen by a condition, not by a {kind}")
    return df.filter(column)
