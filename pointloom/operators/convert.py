"""Layout conversion: a mapping of attributes between schemas, applied as one projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import can_cast, default_value, point_cast
from ..functions.schema import POINT_IDX, Attribute, PointSchema

Change = Callable[[Column], Column]


@dataclass(frozen=True)
class Mapping:
    """Where a target attribute comes from; before and after change the value on either side of the cast."""

    target: Attribute
    source: Attribute | None
    before: Change | None = None
    after: Change | None = None

    def column(self) -> Column:
        if self.source is None:
            value = default_value(self.target.type)
        else:
            value = F.col(self.source.name)
            value = self.before(value) if self.before else value
            value = point_cast(value, self.source.type, self.target.type)
            value = self.after(value) if self.after else value
        return value.alias(self.target.name, metadata={"point_type": self.target.type})


class LayoutConverter:
    """Converts points of one schema to another. Attributes map by name; with defaults, those that the source lacks become zero."""

    def __init__(self, source: PointSchema, target: PointSchema, defaults: bool = False):
        self.source, self.target = source, target
        self.mappings: dict[str, Mapping] = {}
        for t in target.attributes:
            s = source.find(t.name)
            if s is None and not defaults:
                raise ValueError(f"the source has no attribute {t.name!r}")
            self._put(Mapping(t, s))

    def _put(self, m: Mapping) -> None:
        if m.source is not None and not can_cast(m.source.type, m.target.type):
            raise ValueError(f"no conversion from {m.source} to {m.target}")
        self.mappings[m.target.name] = m

    def map(self, source: str, target: str, before: Change | None = None, after: Change | None = None) -> LayoutConverter:
        """Fill `target` from `source`, replacing an earlier mapping; one source may fill several targets."""
        s, t = self.source.find(source), self.target.find(target)
        if s is None or t is None:
            raise ValueError(f"no attribute {source if s is None else target!r}")
        self._put(replace(Mapping(t, s), before=before, after=after))
        return self

    def convert(self, df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
        """The converted points, of a range of indices if given."""
        if not PointSchema.of_frame(df).same_attributes(self.source):
            raise ValueError("the points don't have the source layout")
        if start is not None or end is not None:
            df = df.where((F.col(POINT_IDX) >= (start or 0)) & (F.col(POINT_IDX) < end if end is not None else F.lit(True)))
        return df.select(POINT_IDX, *[self.mappings[t.name].column() for t in self.target.attributes])

    def convert_into(self, df: DataFrame, into: DataFrame, start: int = 0) -> DataFrame:
        """`into` with the points from `start` on replaced by the converted ones; others stay."""
        fresh = self.convert(df).withColumn(POINT_IDX, F.col(POINT_IDX) + start)
        return into.join(fresh.select(POINT_IDX), POINT_IDX, "left_anti").unionByName(fresh)
