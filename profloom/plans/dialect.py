"""User join SQL in the other dialect: what Spark SQL writes differently is rewritten, token by token.

``read_parquet('cells.parquet')`` becomes the group's view, ``EXCLUDE`` becomes ``EXCEPT``,
``COLUMNS('pattern')`` the matching columns of the tables in that FROM clause, double-quoted names
get backticks. Text in quotes and comments is left alone.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from profloom.errors import SchemaException
from profloom.functions.naming import distinct_names
from profloom.plans.joins import matching_columns

_TOKEN = re.compile(r"""--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|[A-Za-z_][A-Za-z_0-9$]*|\s+|.""", re.S)
_CLAUSE_ENDS = {"where", "group", "order", "having", "limit", "qualify", "union", "window"}


def tokens(sql: str) -> list[str]:
    return _TOKEN.findall(sql)


def _skip(parts: list[str], i: int) -> int:
    while i < len(parts) and (parts[i].isspace() or parts[i].startswith(("--", "/*"))):
        i += 1
    return i


def _call(parts: list[str], i: int) -> tuple[list[str], int] | None:
    """Texts of the arguments of a call after position i (names and strings only), and where it ends."""
    i = _skip(parts, i)
    if i >= len(parts) or parts[i] != "(":
        return None
    found, depth = [], 0
    while i < len(parts):
        if parts[i] == "(":
            depth += 1
        elif parts[i] == ")":
            depth -= 1
            if not depth:
                return found, i + 1
        elif parts[i].startswith("'"):
            found.append(parts[i][1:-1].replace("''", "'"))
        i += 1
    return None


def _sources(parts: list[str], start: int) -> list[tuple[str, str]]:
    """(table, alias) of the FROM clause that follows position ``start`` at its own level."""
    depth, i, found, reading = 0, start, [], False
    while i < len(parts):
        word = parts[i].lower()
        if word == "(":
            depth += 1
        elif word == ")":
            depth -= 1
            if depth < 0:
                break
        elif depth == 0 and word in ("from", "join"):
            reading = True
            i = _skip(parts, i + 1)
            if i < len(parts) and re.match(r"[A-Za-z_`]", parts[i]):
                table = parts[i].strip("`")
                j = _skip(parts, i + 1)
                if j < len(parts) and parts[j].lower() == "as":
                    j = _skip(parts, j + 1)
                stops = {"on", "using", "left", "right", "inner", "full", "cross", "join", "semi", "anti", *_CLAUSE_ENDS}
                alias = parts[j].strip("`") if j < len(parts) and re.match(r"[A-Za-z_`]", parts[j]) and parts[j].lower() not in stops else table
                found.append((table, alias))
        elif depth == 0 and reading and word in _CLAUSE_ENDS:
            break
        i += 1
    return found


def to_spark_sql(sql: str, views: Mapping[str, str], columns: Mapping[str, list[str]]) -> str:
    """``sql`` for Spark; ``views`` are view names by lower-case group, ``columns`` the columns of each view."""
    parts = [f"`{t[1:-1].replace('""', '"')}`" if t.startswith('"') else t for t in tokens(sql)]
    out: list[str] = []
    i = 0
    while i < len(parts):
        word, call = parts[i].lower(), None
        if word == "read_parquet":
            call = _call(parts, i + 1)
            if call:
                group = call[0][0].rpartition("/")[2].rpartition(".")[0].lower() if call[0] else ""
                if group not in views:
                    raise SchemaException(f"the join reads {group!r}, but there are {', '.join(sorted(views))}")
                out.append(views[group])
        if call:
            i = call[1]
            continue
        out.append("EXCEPT" if word == "exclude" else parts[i])
        i += 1
    parts, out, i = tokens("".join(out)), [], 0
    while i < len(parts):
        call = _call(parts, i + 1) if parts[i].lower() == "columns" else None
        if call and call[0]:
            chosen = []
            for table, alias in _sources(parts, i):
                for n in columns.get(table, []):
                    if re.search(call[0][0], n):
                        chosen.append(f"{alias}.`{n}`")
            if not chosen:
                matching_columns([], call[0][0])
            out.append(", ".join(chosen))
            i = call[1]
            continue
        out.append(parts[i])
        i += 1
    return "".join(out)


def run_join_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The result of user SQL over group tables, with distinct column names."""
    views = {}
    for group, df in tables.items():
        views[group.lower()] = name = f"profloom_{group.lower()}"
        df.createOrReplaceTempView(name)
    columns = {views[g.lower()]: df.columns for g, df in tables.items()}
    out = spark.sql(to_spark_sql(sql, views, columns))
    return out.toDF(*distinct_names(out.columns))
