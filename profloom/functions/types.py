"""Harmonized column types and the common schema of a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profloom.errors import DatatypeException
from profloom.functions.naming import quoted

# The names that a type may be asked for by.
CAST_NAMES: dict[str, tuple[str, ...]] = {
    "float": ("real", "float32", "float4", "float"),
    "double": ("double", "float64", "float8", "numeric", "decimal"),
    "int": ("integer", "int32", "int4", "int", "signed"),
    "bigint": ("bigint", "int64", "int8", "long"),
}
_SPARK = {"float": T.FloatType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType()}

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
NOT_TEXT = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)  # give way to text


def named_type(name: str) -> T.DataType:
    for spark_name, names in CAST_NAMES.items():
        if name.lower() in names:
            return _SPARK[spark_name]
    raise DatatypeException(f"unknown target type {name!r}")


def harmonized(kind: T.DataType, casts: Mapping[str, str] | None = None) -> T.DataType:
    """Floats become double and integers bigint, or what ``casts`` asks for; inside lists and structs too."""
    casts = casts or {}
    if isinstance(kind, FLOATS):
        return named_type(casts["float"]) if "float" in casts else T.DoubleType()
    if isinstance(kind, INTEGERS):
        return named_type(casts["integer"]) if "integer" in casts else T.LongType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(harmonized(kind.elementType, casts), kind.containsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, harmonized(f.dataType, casts), f.nullable, f.metadata) for f in kind.fields])
    return kind


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (*INTEGERS, *FLOATS, T.DecimalType))


def split_numeric(schema: T.StructType) -> tuple[list[str], list[str]]:
    """Names of the numeric fields (integers, floats, decimals) and of all others."""
    numeric = [f.name for f in schema.fields if is_numeric(f.dataType)]
    known = set(numeric)
    return numeric, [n for n in schema.names if n not in known]


def promoted(base: T.DataType, other: T.DataType) -> T.DataType:
    """The type that holds both: null gives way, integer and float meet in double, numbers and text in text, else the base's type stays."""
    if isinstance(base, T.NullType):
        return other
    if is_numeric(base) and is_numeric(other) and type(base) is not type(other):
        if isinstance(base, INTEGERS) and isinstance(other, INTEGERS):
            return max(base, other, key=lambda t: INTEGERS.index(type(t)))
        return T.DoubleType()
    return other if isinstance(other, T.StringType) and isinstance(base, NOT_TEXT) else base


def common_schema(schemas: Sequence[T.StructType], casts: Mapping[str, str] | None = None) -> tuple[T.StructType, list[str]]:
    """The fields that all schemas have, in the first one's order, and the names of those dropped."""
    first, rest = schemas[0], [{f.name: f.dataType for f in s.fields} for s in schemas[1:]]
    known = set(first.names)
    fields, dropped = [], {n for s in rest for n in s if n not in known}
    for f in first.fields:
        if all(f.name in s for s in rest):
            kind = f.dataType
            for s in rest:
                kind = promoted(kind, s[f.name])
            fields.append(T.StructField(f.name, harmonized(kind, casts)))
        else:
            dropped.add(f.name)
    return T.StructType(fields), sorted(dropped)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` under ``schema``: one projection; texts that aren't of a field's type become null."""
    out, kinds = [], {f.name: f.dataType for f in df.schema.fields}
    for f in schema.fields:
        name, have = quoted(f.name), kinds[f.name]
        if have == f.dataType:
            out.append(name)
        elif isinstance(f.dataType, T.NullType):
            out.append(f"NULL AS {name}")
        else:
            lossy = isinstance(have, T.StringType) and not isinstance(f.dataType, T.StringType)
            out.append(f"{'try_cast' if lossy else 'cast'}({name} AS {_sql_type(f.dataType)}) AS {name}")
    return df.selectExpr(*out)


def _sql_type(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{_sql_type(kind.elementType)}>"
    if isinstance(kind, T.StructType):
        return f"STRUCT<{', '.join(f'{quoted(f.name)}: {_sql_type(f.dataType)}' for f in kind.fields)}>"
    return kind.simpleString()


def cast_types(df: DataFrame, casts: Mapping[str, str] | None = None) -> DataFrame:
    """All columns in their harmonized types."""
    return conform(df, T.StructType([T.StructField(f.name, harmonized(f.dataType, casts)) for f in df.schema.fields]))


def without_void(kind: T.DataType) -> T.DataType | None:
    """The type without fields and elements that are always null; None if nothing is left."""
    if isinstance(kind, T.NullType):
        return None
    if isinstance(kind, T.ArrayType):
        inner = without_void(kind.elementType)
        return None if inner is None else T.ArrayType(inner, kind.containsNull)
    if isinstance(kind, T.StructType):
        fields = [T.StructField(f.name, t, f.nullable) for f in kind.fields if (t := without_void(f.dataType)) is not None]
        return T.StructType(fields) if fields else None
    return kind


def strip_void(value: Column, kind: T.DataType) -> Column | None:
    """``value`` rebuilt without what :func:`without_void` takes from its type."""
    target = without_void(kind)
    if target is None or target == kind:
        return None if target is None else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: strip_void(x, kind.elementType))
    parts = [c.alias(f.name) for f in kind.fields if (c := strip_void(value[f.name], f.dataType)) is not None]
    return F.when(value.isNotNull(), F.struct(*parts))
