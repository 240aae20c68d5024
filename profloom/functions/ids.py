"""Stable identifiers, key fields and bounding boxes of objects and images."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profloom.functions.naming import quoted
from profloom.functions.types import FLOATS, INTEGERS

# Names of keys, box columns and image files that stored identifiers depend on.
IMAGE_KEYS = ("Metadata_TableNumber", "Metadata_ImageNumber", "Image_Metadata_Well", "Image_Metadata_Plate", "Metadata_Well", "Metadata_Plate")
OBJECT_KEYS = ("Metadata_TableNumber", "Metadata_ImageNumber", "Metadata_ObjectNumber", "Image_Metadata_Well", "Image_Metadata_Plate", "Metadata_Well", "Metadata_Plate")
KEY_ENDS = ("_Object_Number", "_Parent_Cells", "_Parent_Nuclei")
BOX_PARTS = ("x_min", "x_max", "y_min", "y_max")
BOX_COLUMNS = {"x_min": "Metadata_SourceBBoxXMin", "x_max": "Metadata_SourceBBoxXMax", "y_min": "Metadata_SourceBBoxYMin", "y_max": "Metadata_SourceBBoxYMax"}
BOX_FEATURES = {"x_min": "Minimum_X", "x_max": "Maximum_X", "y_min": "Minimum_Y", "y_max": "Maximum_Y"}
BOX_PREFIXES = ("Cytoplasm_", "Nuclei_", "Cells_", "")
IMAGE_SUFFIXES = (".tif", ".tiff", ".ome.tif", ".ome.tiff", ".zarr", ".ome.zarr")


def object_id(name: object | None = None, prefix: str = "obj") -> str:
    """A text identifier: name-based and stable, or random without a name."""
    return f"{prefix}-{uuid.uuid4() if name is None else uuid.uuid5(uuid.NAMESPACE_URL, str(name))}"


def stable_id(text: Column, prefix: str = "obj") -> Column:
    """:func:`object_id` of a column, computed in the JVM."""
    space = F.unhex(F.lit(uuid.NAMESPACE_URL.hex))
    h = F.sha1(F.concat(space, F.encode(text, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.lit(f"{prefix}-"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def json_text(text: Column) -> Column:
    """A JSON string in ASCII, as Python's json module writes it."""

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        four = lambda x: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(x), 4, "0")))
        short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
        out = F.when(c == '"', F.lit(short['"']))
        for k, v in list(short.items())[1:]:
            out = out.when(c == k, F.lit(v))
        above = code - 0x10000
        pair = F.concat(four(F.shiftright(above, 10) + 0xD800), four(above.bitwiseAND(0x3FF) + 0xDC00))
        return out.when((code >= 32) & (code < 127), c).when(code > 0xFFFF, pair).otherwise(four(code))

    plain = text.rlike(r'^[ !#-\[\]-~]*$')
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(F.transform(F.split(text, ""), escaped), "")), F.lit('"'))


@F.pandas_udf(T.StringType())
def _repr(values: pd.Series) -> pd.Series:
    out = pd.Series(None, index=values.index, dtype=object)
    some = values.notna()
    out[some] = [repr(float(x)) for x in values[some]]
    return out


def _float_text(value: Column) -> Column:
    """A double as Python writes it; whole ones, as keys are, without a Python worker's help."""
    whole = (value != 0) & (F.abs(value) < 1e15) & (value == F.floor(value))
    return F.coalesce(F.when(whole, F.concat(value.cast("bigint").cast("string"), F.lit(".0"))), _repr(F.when(~F.coalesce(whole, F.lit(False)), value)))


def json_value(df: DataFrame, name: str) -> Column:
    """A column's values in JSON: integers, floats as Python writes them, anything else as text; null if null or NaN."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, INTEGERS):
        return c.cast("string")
    if isinstance(kind, FLOATS):
        return _float_text(c.cast("double"))
    if isinstance(kind, T.BooleanType):
        return c.cast("string")
    return json_text(c.cast("string"))


def key_columns(names: Sequence[str], image_level: bool = False) -> list[str]:
    """The key fields among some column names, sorted as in identifiers."""
    found = [n for n in (IMAGE_KEYS if image_level else OBJECT_KEYS) if n in names]
    if not image_level:
        found += [n for n in names if n.endswith(KEY_ENDS) and n not in found]
    return sorted(set(found))


def _members(items: Sequence[tuple[str, Column]]) -> Column:
    """``{"name": value, …}`` of those with a value."""
    if not items:
        return F.lit("{}")
    members = F.array(*(F.concat(F.lit(f'"{n}": '), v) for n, v in items))
    return F.concat(F.lit("{"), F.array_join(F.filter(members, lambda x: x.isNotNull()), ", "), F.lit("}"))


def _keys_json(df: DataFrame, image_level: bool) -> Column:
    return _members([(n, json_value(df, n)) for n in key_columns(df.columns, image_level)])


def _box_json(box: Mapping[str, Column] | None) -> Column:
    return F.lit("{}") if box is None else _members([(p, box[p].cast("bigint").cast("string")) for p in sorted(box)])


def object_ids(df: DataFrame, box: Mapping[str, Column] | None = None) -> Column:
    """The identifier of each object from its key fields and its box (where that is complete)."""
    return stable_id(F.concat(F.lit('{"bbox": '), _box_json(box), F.lit(', "keys": '), _keys_json(df, False), F.lit("}")))


def _with_file(head: Column, column: Column, file: Column) -> Column:
    return F.concat(head, F.lit(', "source_image_column": '), json_text(column), F.lit(', "source_image_file": '), json_text(file), F.lit("}"))


def crop_ids(df: DataFrame, column: Column, file: Column, box: Mapping[str, Column] | None = None) -> Column:
    """The identifier of each crop: an object's, and the image it is cut from."""
    return stable_id(_with_file(F.concat(F.lit('{"bbox": '), _box_json(box), F.lit(', "keys": '), _keys_json(df, False)), column, file))


def image_ids(df: DataFrame, column: Column, file: Column) -> Column:
    """The identifier of each source image."""
    return stable_id(_with_file(F.concat(F.lit('{"keys": '), _keys_json(df, True)), column, file))


@dataclass(frozen=True)
class Box:
    """Names of the columns that bound objects."""

    x_min: str
    x_max: str
    y_min: str
    y_max: str

    def columns(self) -> dict[str, Column]:
        return {p: F.col(f"`{getattr(self, p)}`") for p in BOX_PARTS}


def resolve_box(names: Sequence[str], given: Mapping[str, str] | None = None) -> Box | None:
    """The box columns: those given, those recoded before, one compartment's, or the first that look like it."""
    have = set(names)
    candidates: list[dict[str, str | None]] = [dict(given or {}), dict(BOX_COLUMNS)]
    candidates += [{p: f"{prefix}AreaShape_BoundingBox{BOX_FEATURES[p]}" for p in BOX_PARTS} for prefix in BOX_PREFIXES]
    candidates.append({p: next((n for n in names if BOX_FEATURES[p] in n), None) for p in BOX_PARTS})
    for c in candidates:
        if all(c.get(p) in have for p in BOX_PARTS):
            return Box(**{p: c[p] for p in BOX_PARTS})
    return None


def box_bounds(box: Box, whole: bool) -> dict[str, Column]:
    """The bounds as numbers, or null where a value isn't one; cut to whole numbers if ``whole``."""
    bounds = {p: c.cast("string").try_cast("double") for p, c in box.columns().items()}
    bounds = {p: F.when(~F.isnan(c), c) for p, c in bounds.items()}
    return {p: c.cast("bigint") for p, c in bounds.items()} if whole else bounds


def box_is_valid(bounds: Mapping[str, Column]) -> Column:
    return F.coalesce((bounds["x_min"] < bounds["x_max"]) & (bounds["y_min"] < bounds["y_max"]), F.lit(False))


def recode_box(df: DataFrame, given: Mapping[str, str] | None = None) -> DataFrame:
    """Rename the box columns to their metadata names, unless these exist."""
    box = resolve_box(df.columns, given)
    if box is None:
        return df
    new = {getattr(box, p): n for p, n in BOX_COLUMNS.items() if n not in df.columns}
    return df.withColumnsRenamed(new)


def stamp_object_ids(df: DataFrame, given: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with recoded box and ``Metadata_ObjectID`` behind its metadata columns; ids that exist stay."""
    box = resolve_box(df.columns, given)
    bounds = None
    if box is not None:
        whole = box_bounds(box, True)
        valid = box_is_valid(whole)
        bounds = {p: F.when(valid, c) for p, c in whole.items()}
    new = object_ids(df, bounds)
    if "Metadata_ObjectID" in df.columns:
        return recode_box(df.withColumn("Metadata_ObjectID", F.coalesce("Metadata_ObjectID", new)), given)
    out = recode_box(df.withColumn("Metadata_ObjectID", new), given)
    rest = [n for n in out.columns if n != "Metadata_ObjectID"]
    at = sum(n.startswith("Metadata_") for n in rest)
    return out.select(*(F.col(f"`{n}`") for n in [*rest[:at], "Metadata_ObjectID", *rest[at:]]))


def file_value(value: Column) -> Column:
    """A stored image reference as a POSIX path: without ``file:``, repeated slashes and ``.`` parts."""
    path = F.regexp_replace(F.regexp_replace(value.cast("string"), "^file:", ""), r"/(\./)+|/{2,}", "/")
    return F.when(F.length(path) > 1, F.regexp_replace(path, "(?<=.)/$", "")).otherwise(path)


def image_columns(df: DataFrame) -> list[str]:
    """Text columns of which some value names an image file; one pass over all values, so their order doesn't matter."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return []
    ends = "(" + "|".join(map(re.escape, IMAGE_SUFFIXES)) + ")$"
    found = df.agg(*(F.max(F.lower(F.col(quoted(n))).rlike(ends)).alias(str(i)) for i, n in enumerate(texts))).first()
    return [n for n, hit in zip(texts, found) if hit]
