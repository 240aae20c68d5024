"""Names of columns, groups and files: prefixes by compartment, order, disambiguation, natural sort."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of columns, by whole lower-case name, then by part, then by start.
EXACT_ORDER = ("tablenumber", "metadata_tablenumber", "imagenumber", "metadata_imagenumber", "objectnumber", "object_number")
PART_ORDER = "metadata"
START_ORDER = ("image", "cytoplasm", "cells", "nuclei")


def compartment_stem(group: str, metadata: Sequence[str], compartments: Sequence[str]) -> str | None:
    """The capitalized metadata or compartment name that the group's file name contains, if any."""
    name = PurePosixPath(group).stem.lower()
    return next((c.capitalize() for c in (*metadata, *compartments) if c.lower() in name), None)


def prefixed_name(name: str, stem: str, identifying: Sequence[str], metadata: Sequence[str]) -> str:
    """The harmonized name of a column of the compartment ``stem``.

    Features get the compartment's name in front; identifying columns get ``Metadata_``, with the
    compartment between if nothing else tells where they come from.
    """
    if name not in identifying:
        return name if name.startswith(stem) else f"{stem}_{name}"
    if name.startswith(stem):
        return f"Metadata_{name}"
    if name.startswith("Metadata_"):
        return name
    of_no_table = not any(part in name for part in (*(m.capitalize() for m in metadata), "ObjectNumber", "TableNumber"))
    return f"Metadata_{stem}_{name}" if of_no_table else f"Metadata_{name}"


def prefixed_names(names: Iterable[str], group: str, identifying: Sequence[str], metadata: Sequence[str], compartments: Sequence[str]) -> list[str]:
    """Harmonized names of all columns of a group; unchanged if the group belongs to no known compartment."""
    stem = compartment_stem(group, metadata, compartments)
    return [n if stem is None else prefixed_name(n, stem, identifying, metadata) for n in names]


def quoted(name: str) -> str:
    """A column's name in SQL text. Wide projections are written as SQL: one call for each column, not one for each step."""
    return "`" + name.replace("`", "``") + "`"


def column_rank(name: str) -> int:
    low = name.lower()
    if low in EXACT_ORDER:
        return EXACT_ORDER.index(low)
    if PART_ORDER in low:
        return len(EXACT_ORDER)
    for i, start in enumerate(START_ORDER, len(EXACT_ORDER) + 1):
        if low.startswith(start):
            return i
    return len(EXACT_ORDER) + 1 + len(START_ORDER)


def ordered_columns(names: Iterable[str]) -> list[str]:
    """Keys first, then metadata, image and compartments; equal ranks by code points."""
    return sorted(names, key=lambda n: (column_rank(n), n))


def distinct_names(names: Iterable[str]) -> list[str]:
    """Make names distinct regardless of case: the first keeps its name, later ones get ``_1``, ``_2``, …"""
    taken: set[str] = set()
    out = []
    for name in names:
        new, i = name, 0
        while new.lower() in taken:
            i += 1
            new = f"{name}_{i}"
        taken.add(new.lower())
        out.append(new)
    return out


def last_occurrences(names: Sequence[str]) -> list[int]:
    """Positions that stay when of equal names only the last is kept."""
    last = {n: i for i, n in enumerate(names)}
    return sorted(last.values())


def natural_key(text: str) -> tuple:
    """Sort key by which runs of digits count as numbers."""
    return tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", str(text)))


def natural_column(text: Column) -> Column:
    """A text by which Spark sorts as :func:`natural_key` does: before each run of digits its length without leading zeros."""
    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    digits = lambda x: F.regexp_replace(x, "^0+", "")
    numbered = lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(x)).cast("string"), 10, "0"), digits(x))).otherwise(x)
    return F.array_join(F.transform(runs, numbered), "")


def natural_sort(texts: Iterable[str]) -> list[str]:
    return sorted(texts, key=natural_key)
