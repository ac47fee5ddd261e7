"""A single point whose attributes are read and written by name and type at run time, with the casts of the columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Row

from .casts import can_cast
from .schema import SCALARS, VECTORS, Attribute, PointSchema, parse_type

Value = int | float | tuple | bytes


def cast_number(value: int | float, target: str) -> int | float:
    """Floats truncate and saturate, NaN is 0; integers wrap; everything rounds to floats."""
    limits = SCALARS[target][2]
    if limits is None:
        with np.errstate(over="ignore"):
            return float(value if target == "f64" else np.float32(value))
    low, high = limits
    if isinstance(value, float):
        return 0 if math.isnan(value) else low if value <= low else high if value >= high else int(value)
    return (int(value) - low) % (high - low + 1) + low


def cast_value(value: Value, source: str, target: str) -> Value:
    if source == target:
        return value
    if not can_cast(source, target):
        raise ValueError(f"no conversion from {source} to {target}")
    if source in SCALARS:
        number = float(value) if SCALARS[source][2] is None else int(value)
        return cast_number(number, target)
    return tuple(cast_value(v, VECTORS[source][0], VECTORS[target][0]) for v in value)


def zero(kind: str) -> Value:
    base, size = parse_type(kind)
    if base in SCALARS:
        return 0.0 if SCALARS[base][2] is None else 0
    return (zero(VECTORS[base][0]),) * len(VECTORS[base][1]) if base in VECTORS else bytes(size)


class UntypedPoint:
    """A point of a schema; of_row takes one from a points table, row gives it back."""

    def __init__(self, schema: PointSchema, values: dict[str, Value] | None = None):
        self.schema = schema
        self.values = {a.name: zero(a.type) for a in schema.attributes} | (values or {})

    @classmethod
    def of_row(cls, schema: PointSchema, row: Row) -> UntypedPoint:
        plain = lambda v: tuple(v) if isinstance(v, Row) else bytes(v) if isinstance(v, bytearray) else v
        return cls(schema, {a.name: plain(row[a.name]) for a in schema.attributes})

    def _attribute(self, name: str) -> Attribute:
        found = self.schema.find(name)
        if found is None:
            raise ValueError(f"no attribute {name!r}")
        return found

    def get(self, name: str, kind: str | None = None) -> Value:
        """The attribute's value, as another type if asked."""
        a = self._attribute(name)
        return cast_value(self.values[name], a.type, kind or a.type)

    def set(self, name: str, value: Value, kind: str | None = None) -> None:
        """Store a value of a type, cast to the attribute's."""
        a = self._attribute(name)
        self.values[name] = cast_value(value, kind or a.type, a.type)

    def row(self, index: int) -> tuple:
        return (index, *[self.values[a.name] for a in self.schema.attributes])

    def __repr__(self) -> str:
        return f"UntypedPoint({', '.join(f'{a}: {self.values[a.name]}' for a in self.schema.attributes)})"
