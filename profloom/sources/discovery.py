"""Finding, grouping and checking measurement files.

Listing and grouping are metadata work on the driver; anything that has to open many files
(line counts, checksums) runs as a Spark job over the paths.
"""

from __future__ import annotations

import fnmatch
import logging
import os
import sqlite3
import zlib
from collections.abc import Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass, replace
from itertools import islice
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import SparkSession

from profloom.errors import DatatypeException, NoInputDataException
from profloom.sources import storage

log = logging.getLogger(__name__)

# The file types that can be read.
SUFFIXES = (".csv", ".npz", ".sqlite")


@dataclass(frozen=True)
class Source:
    """One file, or one table of a database file."""

    path: str
    table: str | None = None
    table_number: int | None = None

    @property
    def suffix(self) -> str:
        return os.path.splitext(self.path)[1].lower()

    @property
    def stem(self) -> str:
        return os.path.splitext(os.path.basename(self.path))[0]

    @property
    def parent(self) -> str:
        return os.path.dirname(self.path)


Groups = dict[str, list[Source]]


def expand_path(path: str | os.PathLike) -> str:
    """Without quotes and blanks around, with ``~`` and environment variables filled in; URIs stay as they are."""
    text = str(path).strip().strip("'\"").strip()
    text = "/" + text.removeprefix("file:").lstrip("/") if text.startswith("file:/") else text
    if "://" in text:
        return text
    return os.path.abspath(os.path.expandvars(os.path.expanduser(text)))


def walk_files(start: str, pattern: str = "*", most: int | None = None) -> list[str]:
    """Files below ``start`` whose relative path or name matches ``pattern``, in order of paths.

    Symbolic links are followed; a file or folder reached twice counts once, so cycles end.
    URIs are listed through the file system of their scheme.
    """
    start = expand_path(start)
    found = _remote_files(start, pattern) if "://" in start else _local_files(start, pattern)
    return list(islice(found, most))


def _matches(relative: str, pattern: str) -> bool:
    pattern = pattern.removeprefix("./")
    if "/" not in pattern:
        return fnmatch.fnmatchcase(os.path.basename(relative), pattern)
    return fnmatch.fnmatchcase(relative, pattern.replace("**/", "*"))


def _local_files(start: str, pattern: str) -> Iterator[str]:
    if os.path.isfile(start):
        yield start
        return
    seen_folders: set[str] = set()
    seen_files: set[str] = set()
    for folder, below, names in os.walk(start, followlinks=True):
        real = os.path.realpath(folder)
        if real in seen_folders:
            below.clear()
            continue
        seen_folders.add(real)
        below.sort()
        for name in sorted(names):
            path = os.path.join(folder, name)
            target = os.path.realpath(path)
            if target not in seen_files and os.path.isfile(path) and _matches(os.path.relpath(path, start), pattern):
                seen_files.add(target)
                yield path


def _remote_files(start: str, pattern: str) -> Iterator[str]:
    system, root = storage.locate(start)
    host = start[: start.index(root)] if root in start else start.partition("://")[0] + "://"  # what stands before paths of the file system
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        yield start
        return
    for x in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda x: x.path):
        if x.type == fs.FileType.File and _matches(os.path.relpath(x.path, root), pattern):
            yield f"{host}{x.path}"


def open_database(path: str, at: storage.Locate = storage.locate) -> sqlite3.Connection:
    """A database, read only; one that isn't a local file is held in memory."""
    system, place = at(path)
    if isinstance(system, fs.LocalFileSystem):
        return sqlite3.connect(f"file:{quote(place)}?mode=ro", uri=True)
    db = sqlite3.connect(":memory:")
    db.deserialize(storage.read_bytes(path, at))
    return db


def sqlite_tables(path: str) -> list[str]:
    with closing(open_database(path)) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') ORDER BY name")]


def find_sources(path: str, targets: Sequence[str] | None, datatype: str | None) -> Groups:
    """Files below ``path`` in groups by capitalized file name.

    With targets, CSV and NPZ files count whose stem is a target, and of databases the tables whose name
    contains one. Without, all files of ``datatype`` form one group named by their common start.
    """
    if not targets and datatype is None:
        raise DatatypeException("either targets or a source datatype must be given")
    wanted = [t.lower() for t in targets or ()]
    files = walk_files(path)
    sources: list[Source] = []
    for f in files:
        suffix, stem = os.path.splitext(f)[1].lower(), os.path.splitext(os.path.basename(f))[0].lower()
        if suffix not in SUFFIXES or (wanted and suffix != ".sqlite" and stem not in wanted):
            continue
        if suffix == ".sqlite":
            sources += [Source(f, t) for t in sqlite_tables(f) if not wanted or any(w in t.lower() for w in wanted)]
        else:
            sources.append(Source(f))
    if datatype is not None and not wanted:
        sources = [s for s in sources if s.suffix == f".{datatype}"]
    if not sources:
        raise NoInputDataException(f"no input data was found at {path}")
    if not wanted:
        stems = sorted({s.stem.lower() for s in sources})
        name = os.path.commonprefix(stems) or "all_files"
        return {f"{name}.{datatype}".capitalize(): sources}
    groups: Groups = {}
    for s in sources:
        name = f"{s.table}.sqlite" if s.table else os.path.basename(s.path)
        groups.setdefault(name.capitalize(), []).append(s)
    return groups


def infer_datatype(groups: Groups, datatype: str | None = None) -> str:
    """The one file type of the groups, or the given one if it is among them."""
    found = sorted({s.suffix.lstrip(".") for sources in groups.values() for s in sources})
    if datatype is not None:
        if datatype not in found:
            raise DatatypeException(f"there are no {datatype} files, but {', '.join(found)}")
        return datatype
    if len(found) != 1:
        raise DatatypeException(f"the source datatype must be given, as there are {', '.join(found)}")
    return found[0]


def has_records(path: str, at: storage.Locate = storage.locate) -> bool:
    """Whether a text file has more than one line."""
    system, place = at(path)
    with system.open_input_stream(place) as f:
        begun = False
        while block := f.read(1 << 16):
            end = block.find(b"\n")
            if begun or 0 <= end < len(block) - 1:
                return True
            begun = end >= 0
    return False


def drop_invalid(spark: SparkSession | None, groups: Groups, datatype: str) -> Groups:
    """Without files of other types, empty files and CSV files that are only a header."""
    typed = {g: [s for s in sources if s.suffix == f".{datatype}"] for g, sources in groups.items()}
    paths = sorted({s.path for sources in typed.values() for s in sources})
    check, at = datatype == "csv", storage.resolver()

    def valid(path: str) -> bool:
        system, place = at(path)
        return bool(system.get_file_info(place).size) and (not check or has_records(path, at))

    if spark is not None and len(paths) > 1000:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame[[valid(p) for p in frame["path"]]]

        good = {r["path"] for r in spark.createDataFrame([(p,) for p in paths], "path string").repartition(spark.sparkContext.defaultParallelism * 4).mapInPandas(run, "path string").collect()}
    else:
        good = {p for p in paths if valid(p)}
    out = {g: [s for s in sources if s.path in good] for g, sources in typed.items()}
    for g, sources in typed.items():
        if len(sources) > len(out[g]):
            log.warning("%d empty files of group %s are left out", len(sources) - len(out[g]), g)
    return {g: sources for g, sources in out.items() if sources}


def gather_sources(spark: SparkSession | None, path: str, targets: Sequence[str] | None = None, datatype: str | None = None) -> tuple[Groups, str]:
    """All steps: find, group, infer the type, check."""
    groups = find_sources(path, targets, datatype)
    kind = infer_datatype(groups, datatype)
    groups = drop_invalid(spark, groups, kind)
    if not groups:
        raise NoInputDataException(f"no file with records was found at {path}")
    return groups, kind


def checksum(path: str, at: storage.Locate = storage.locate) -> int:
    """CRC-32 of a whole file, read in blocks."""
    value = 0
    system, place = at(path)
    with system.open_input_stream(place) as f:
        while block := f.read(1 << 20):
            value = zlib.crc32(block, value)
    return value & 0xFFFFFFFF


def number_tables(spark: SparkSession, groups: Groups, add: bool | None = None, image: str = "image") -> Groups:
    """Give every source the checksum of its image table as table number.

    The image table of a source is the one in its folder, or for databases the file itself. Nothing is
    numbered if ``add`` is False, or None with at most one image table. Sources without an image table drop out.
    """
    if add is False:
        return groups
    place = lambda s: s.path if s.suffix == ".sqlite" else s.parent
    images = {place(s): s.path for g, sources in groups.items() if image in g.lower() for s in sources}
    if not images or (add is None and len(images) <= 1):
        return groups

    at = storage.resolver()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(number=[checksum(p, at) for p in frame["path"]])

    paths = spark.createDataFrame(list(images.items()), "place string, path string")
    tasks = min(len(images), spark.sparkContext.defaultParallelism * 4)
    numbers = {r["place"]: r["number"] for r in paths.repartition(tasks).mapInPandas(run, "place string, path string, number bigint").collect()}
    return {g: [replace(s, table_number=numbers[place(s)]) for s in sources if place(s) in numbers] for g, sources in groups.items()}
