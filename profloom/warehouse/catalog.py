"""The catalog: namespaces, tables as lists of Parquet snapshots, and saved views, in one JSON file.

Every change writes the registry's next version, under its number, if no other writer has: then the change is made
anew on what that one left. So readers see either the old or the new state, no change is lost, and a failed append leaves
nothing but unreferenced files. Versions below the newest are history.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from profloom.errors import NoInputDataException, ProfileException, SchemaException
from profloom.sources import storage

REGISTRY = "catalog.json"
DATA = "warehouse"
DEFAULT_NAMESPACE = "profiles"

ViewBuilder = Callable[["Catalog", SparkSession, dict], DataFrame]
VIEW_KINDS: dict[str, ViewBuilder] = {}


def view_kind(name: str) -> Callable[[ViewBuilder], ViewBuilder]:
    """Register the function that builds views of a kind."""

    def add(f: ViewBuilder) -> ViewBuilder:
        VIEW_KINDS[name] = f
        return f

    return add


def qualified(name: str, namespace: str) -> str:
    return name if "." in name else f"{namespace}.{name}"


@dataclass
class Catalog:
    root: str
    registry_file: str = REGISTRY
    default_namespace: str = DEFAULT_NAMESPACE

    def version(self) -> int:
        """The number of the newest registry, 0 if there is none."""
        stem, dot, end = self.registry_file.rpartition(".")
        pattern = re.compile(re.escape(stem if dot else end) + r"-([0-9]{8,})" + re.escape(dot + end if dot else ""))
        return max((int(m.group(1)) for n in storage.files_in(self.root) if (m := pattern.fullmatch(n))), default=0)

    def _registry(self, version: int) -> str:
        stem, dot, end = self.registry_file.rpartition(".")
        return storage.join(self.root, f"{stem if dot else end}-{version:08d}{dot + end if dot else ''}")

    def state(self) -> dict[str, Any]:
        return self._load(self.version())

    def _load(self, version: int) -> dict[str, Any]:
        return json.loads(storage.read_bytes(self._registry(version))) if version else {"namespaces": [], "tables": {}, "views": {}}

    def _change(self, change: Callable[[dict[str, Any]], None]) -> None:
        """Apply ``change`` to the newest state and save the result as its successor."""
        while True:
            version = self.version()
            state = self._load(version)
            change(state)
            if storage.create(self._registry(version + 1), json.dumps(state, indent=1).encode()):
                return

    def create_namespace(self, name: str) -> None:
        def add(state: dict[str, Any]) -> None:
            if name not in state["namespaces"]:
                state["namespaces"].append(name)

        self._change(add)

    def namespaces(self) -> list[str]:
        return list(self.state()["namespaces"])

    def table_exists(self, name: str) -> bool:
        return qualified(name, self.default_namespace) in self.state()["tables"]

    def view_exists(self, name: str) -> bool:
        return qualified(name, self.default_namespace) in self.state()["views"]

    def create_table(self, name: str, schema: T.StructType, if_missing: bool = False) -> None:
        """Register an empty table."""
        full = qualified(name, self.default_namespace)
        namespace = full.rpartition(".")[0]

        def add(state: dict[str, Any]) -> None:
            if full in state["views"] or (full in state["tables"] and not if_missing):
                raise ProfileException(f"{full} exists already")
            if namespace not in state["namespaces"]:
                state["namespaces"].append(namespace)
            state["tables"].setdefault(full, {"schema": schema.jsonValue(), "snapshots": []})

        self._change(add)

    def append(self, name: str, df: DataFrame) -> str:
        """Add the rows of ``df`` as a snapshot; its columns must be the table's."""
        full = qualified(name, self.default_namespace)
        if full not in self.state()["tables"]:
            self.create_table(full, df.schema, if_missing=True)
        schema = self.schema(full)
        if [(f.name, f.dataType) for f in df.schema.fields] != [(f.name, f.dataType) for f in schema.fields]:
            raise SchemaException(f"the rows to append don't have the columns of {full}")
        snapshot = uuid.uuid4().hex
        df.write.parquet(storage.join(self.root, DATA, *full.split("."), snapshot))
        self._change(lambda state: state["tables"][full]["snapshots"].append(snapshot))
        return snapshot

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self.state()["tables"][self.resolve(name)]["schema"])

    def snapshots(self, name: str) -> list[str]:
        return list(self.state()["tables"][self.resolve(name)]["snapshots"])

    def folders(self, full: str) -> list[str]:
        return [storage.join(self.root, DATA, *full.split("."), s) for s in self.state()["tables"][full]["snapshots"]]

    def create_view(self, name: str, kind: str, **definition: Any) -> None:
        if kind not in VIEW_KINDS:
            raise ProfileException(f"unknown kind of view {kind!r}; there are {', '.join(VIEW_KINDS)}")
        full = qualified(name, self.default_namespace)

        def add(state: dict[str, Any]) -> None:
            if full in state["tables"] or full in state["views"]:
                raise ProfileException(f"{full} exists already")
            state["views"][full] = {"kind": kind, **definition}

        self._change(add)

    def names(self, include_views: bool = True) -> list[str]:
        state = self.state()
        return sorted([*state["tables"], *(state["views"] if include_views else ())])

    def resolve(self, name: str) -> str:
        """The full name: as given with a dot, else in the default namespace, else the only one of that name."""
        known = self.names()
        if "." in name:
            if name not in known:
                raise NoInputDataException(f"there is no table {name}; there are {', '.join(known)}")
            return name
        if (full := f"{self.default_namespace}.{name}") in known:
            return full
        found = [k for k in known if k.rpartition(".")[2] == name]
        if len(found) != 1:
            raise NoInputDataException(f"there is no table {name}" if not found else f"{name} is ambiguous: {', '.join(found)}")
        return found[0]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """A table or view as a lazy DataFrame; filters and column choices reach the files."""
        full, state = self.resolve(name), self.state()
        if full in state["views"]:
            view = state["views"][full]
            if view["kind"] not in VIEW_KINDS:
                raise ProfileException(f"{full} is a view of unknown kind {view['kind']!r}")
            return VIEW_KINDS[view["kind"]](self, spark, view)
        schema, folders = self.schema(full), self.folders(full)
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def drop_table(self, name: str) -> None:
        raise NotImplementedError("tables can't be dropped")

    def rename_table(self, old: str, new: str) -> None:
        raise NotImplementedError("tables can't be renamed")

    def update_properties(self, namespace: str, **properties: str) -> None:
        raise NotImplementedError("namespaces have no properties")


@view_kind("sql")
def _sql_view(catalog: Catalog, spark: SparkSession, view: dict) -> DataFrame:
    """A view defined by SQL over the catalog's tables, written as {namespace.table}."""
    sql = view["sql"]
    for name in catalog.names(include_views=False):
        local = "profloom_" + name.replace(".", "_")
        if name in sql:
            catalog.read(spark, name).createOrReplaceTempView(local)
            sql = sql.replace("{" + name + "}", local)
    return spark.sql(sql)
