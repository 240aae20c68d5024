"""Joins of compartments to image metadata, from declarative specifications.

Columns are held by position until the end, so equal names on several sides never collide; the
result gets distinct names, the first of equal names keeping its own.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profloom.errors import SchemaException
from profloom.functions.naming import distinct_names, quoted


@dataclass(frozen=True)
class JoinSpec:
    """How object compartments join one anchor compartment, and this the image table.

    ``keys`` are equal on all sides; ``match`` gives, for each other compartment, its column and the
    anchor's column that it equals. Unmatched anchor rows stay if ``keep_unmatched``. Images always join
    from the left: objects without image stay, images without objects give no rows.
    """

    keys: tuple[str, ...]
    match: Mapping[str, tuple[str, str]]
    image_select: tuple[str, ...] = ()
    image_pattern: str | None = "Image_FileName_.*"
    without: tuple[str, ...] = ()
    anchor: str = "cytoplasm"
    image: str = "image"
    keep_unmatched: bool = False
    extra_keys: tuple[str, ...] = field(default=())


def matching_columns(names: Sequence[str], pattern: str) -> list[str]:
    """Names in which ``pattern`` is found anywhere; an error if there are none."""
    found = [n for n in names if re.search(pattern, n)]
    if not found:
        raise SchemaException(f"no column matches {pattern!r}")
    return found


def except_columns(names: Sequence[str], without: Sequence[str]) -> list[str]:
    low = {w.lower() for w in without}
    return [n for n in names if n.lower() not in low]


class _Side:
    def __init__(self, role: str, df: DataFrame) -> None:
        self.names = df.columns
        self.place = {n: f"{role}__{i}" for i, n in enumerate(df.columns)}
        self.df = df.toDF(*(self.place[n] for n in df.columns))

    def held(self, name: str) -> str:
        if name not in self.place:
            raise SchemaException(f"column {name} is missing; there are {', '.join(self.names[:20])}")
        return self.place[name]

    def col(self, name: str) -> Column:
        return F.col(self.held(name))


def join_compartments(tables: Mapping[str, DataFrame], spec: JoinSpec) -> DataFrame:
    """The joined table of ``spec``; ``tables`` are by role (image and compartments)."""
    sides = {role: _Side(role, df) for role, df in tables.items() if role in (spec.image, spec.anchor, *spec.match)}
    missing = {spec.image, spec.anchor, *spec.match} - set(sides)
    if missing:
        raise SchemaException(f"no table for {', '.join(sorted(missing))}")
    keys = (*spec.keys, *spec.extra_keys)
    base = sides[spec.anchor]
    out = base.df
    for role, (own, anchors) in spec.match.items():
        side = sides[role]
        condition = side.col(own) == base.col(anchors)
        for k in keys:
            condition &= side.col(k) == base.col(k)
        out = out.join(side.df, condition, "left" if spec.keep_unmatched else "inner")
    image = sides[spec.image]
    condition = F.lit(True)
    for k in keys:
        condition &= image.col(k) == base.col(k)
    # the image table has one row per image; if it is small enough AQE broadcasts it, else it is sorted and merged
    out = out.join(image.df, condition, "left")

    chosen = [(n, image.held(n)) for n in spec.image_select]
    if spec.image_pattern:
        chosen += [(n, image.held(n)) for n in matching_columns(image.names, spec.image_pattern)]
    for role in (spec.anchor, *spec.match):
        chosen += [(n, sides[role].held(n)) for n in except_columns(sides[role].names, spec.without)]
    names = distinct_names(n for n, _ in chosen)
    return out.selectExpr(*(f"{held} AS {quoted(n)}" for n, (_, held) in zip(names, chosen)))
