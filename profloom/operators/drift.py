"""Schemas that drift between files: one consistent table and a report of each change.

Headers and values of every file are read in parallel; a file is compared with the one before it
in its series; the kinds of each field are folded in order along the series, and over all files
through the lattice ``none < whole < number < text`` into the schema of one table.

No task holds a series: files are put in order by range partitions, and each partition is one stream
in which a file meets the one before it, so bodies move once and are parsed once. What a partition
can't know, the file before its first one and the kinds its fields had until then, stays symbolic:
the stream gives its ends and the retypings that hang on it as one small row. These rows, one per
partition, are compared with their neighbours and chained.

Defined cases: empty bodies have no fields; a byte-order mark is dropped; of fields named twice in a
header the first counts; cells missing from a short line are blank, surplus cells are ignored; blank
is empty or white space; of several lines of one image (a blank is one)
the first counts for renames and all count for kinds; null bodies are empty;
files of a null series form one series, null times come first, ties follow file_id, then the body; a row that
occurs again is a file of its own, without changes.
"""

from __future__ import annotations

import csv
import io
import json
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profloom.runtime import materialize, shuffle_partitions, slices

csv.field_size_limit((1 << 31) - 1)  # cells may be very long

KEY_FIELD = "ImageNumber"
KINDS = ("none", "whole", "number", "text")  # the lattice, a chain
_WHOLE = r"-?[0-9]+"
_NUMBER = r"-?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[nN][aA][nN]"
WHOLE, NUMBER = re.compile(_WHOLE), re.compile(_NUMBER)
NOT_BLANK = r"[^\t-\r\x1c-\x20\x85\pZ]"  # a sign that isn't white space


@dataclass
class Export:
    """One file: field names in order, and the cells of each."""

    names: list[str]
    columns: list[Sequence[str]]
    n: int

    @cached_property
    def place(self) -> dict[str, int]:
        return {n: i for i, n in enumerate(self.names)}

    @cached_property
    def images(self) -> dict[str, int]:
        """The first record of each image."""
        out: dict[str, int] = {}
        if KEY_FIELD in self.place:
            for k, cell in enumerate(self.columns[self.place[KEY_FIELD]]):
                out.setdefault(canonical(cell), k)
        return out


def parse_export(body: str | None) -> Export:
    """The header and the records of one export, each as long as the header."""
    lines = [x for x in csv.reader(io.StringIO((body or "").removeprefix("\ufeff"), newline="")) if x]
    if not lines:
        return Export([], [], 0)
    width = len(lines[0])
    records = [x if len(x) == width else (x + [""] * (width - len(x)))[:width] for x in lines[1:]]
    first = {}
    for i, n in enumerate(lines[0]):
        first.setdefault(n, i)
    columns = list(zip(*records)) if records else [()] * width
    return Export(list(first), [columns[i] for i in first.values()], len(records))


def canonical(cell: str) -> str:
    """A text that is the same for equal texts and for equal numbers, whatever their length.

    Numbers are equal if they are so as decimals: significant digits without zeros at their ends, and the power of ten behind them.
    """
    if NUMBER.fullmatch(cell) is None:
        return "" if not cell.strip() else "t" + cell
    if cell[-1] in "nN":
        return "nan"
    mantissa, _, power = cell.lower().partition("e")
    before, _, behind = mantissa.lstrip("-").partition(".")
    digits = (before + behind).lstrip("0")
    kept = digits.rstrip("0")
    if not kept:
        return "0"
    exponent = len(digits) - len(kept) - len(behind) + (_integer(power) if power else 0)
    return f"{'-' if cell[0] == '-' else ''}{kept}e{exponent:x}"


def _integer(text: str) -> int:
    """A whole number of any length; ``int`` takes 4 300 digits at most."""
    digits, value = text.lstrip("+-"), 0
    for i in range(0, len(digits), 4000):
        part = digits[i : i + 4000]
        value = value * 10 ** len(part) + int(part)
    return -value if text[0] == "-" else value


@dataclass
class Cells:
    """All cells of some exports in one array, field by field."""

    texts: pa.Array
    whole: np.ndarray
    number: np.ndarray
    filled: np.ndarray
    starts: np.ndarray  # of each field

    def widest(self, rank: np.ndarray) -> np.ndarray:
        """The largest rank of each field, 0 without cells."""
        out = np.zeros(len(self.starts) - 1, np.int64)
        some = np.flatnonzero(np.diff(self.starts))
        if len(some):
            out[some] = np.maximum.reduceat(rank, self.starts[some])
        return out

    @property
    def rank(self) -> np.ndarray:
        return np.where(self.filled, 3 - self.number.astype(np.int64) - self.whole, 0)


def cells_of(exports: Sequence[Export]) -> Cells:
    texts = pa.array(list(chain.from_iterable(c for e in exports for c in e.columns)), pa.large_string())
    sizes = np.array([e.n for e in exports for _ in e.columns], np.int64)
    match = lambda pattern: pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
    return Cells(texts, match(f"^{_WHOLE}$"), match(f"^({_NUMBER})$"), match(NOT_BLANK), np.concatenate([[0], np.cumsum(sizes)]))


def kinds_of(exports: Sequence[Export]) -> list[dict[str, int]]:
    """Of each export the widest kind of each field over all its cells that aren't blank, as an index of KINDS."""
    cells = cells_of(exports)
    widest = iter(cells.widest(cells.rank).tolist())
    return [{n: next(widest) for n in e.names} for e in exports]


def compare(now: Export, kinds: dict[str, int], before: Export | None) -> dict:
    """What a file has and how it differs from the one before (None: it is the first): fields [name, kind, name before] and removed names."""
    if before is None:
        return {"fields": [[n, kinds[n], None] for n in now.names], "removed": [], "first": True}
    gone = [n for n in before.names if n not in now.place]
    came = [n for n in now.names if n not in before.place]
    renamed: dict[str, str] = {}
    if gone and came:
        both = [(k, before.images[i]) for i, k in now.images.items() if i in before.images]
        values = lambda e, n, rows: tuple(canonical(e.columns[e.place[n]][k]) for k in rows)
        old: dict[tuple, list[str]] = {}
        for n in reversed(gone):
            old.setdefault(values(before, n, [k for _, k in both]), []).append(n)
        for n in came:
            value = values(now, n, [k for k, _ in both])
            if any(value) and old.get(value):
                renamed[n] = old[value].pop()
    taken = set(renamed.values())
    return {
        "fields": [[n, kinds[n], n if n in before.place else renamed.get(n)] for n in now.names],
        "removed": [n for n in gone if n not in taken],
        "first": False,
    }


def step(state: dict[str, object], digest: dict) -> tuple[dict[str, object], list[tuple[str, str]], list[tuple[str, int, str]]]:
    """One file's fold: the state (field → kind last seen, 0 if none) after it, its changes in header order, and open retypings.

    A kind may also be the name of a field of the partition's first file, in which it isn't known; a field whose kind
    is compared with such is open: (field, its kind, that name).
    """
    after: dict[str, object] = {}
    changes: list[tuple[str, str]] = []
    opened: list[tuple[str, int, str]] = []
    for name, kind, before in digest["fields"]:
        last = state.get(before, 0) if before is not None and not digest["first"] else 0
        if not digest["first"] and before is None:
            changes.append((name, "added"))
        elif before is not None and before != name:
            changes.append((name, "renamed"))
        if kind and isinstance(last, str):
            opened.append((name, kind, last))
        elif kind and last and last != kind:
            changes.append((name, "retyped"))
        after[name] = kind or last
    changes += [(n, "removed") for n in digest["removed"]]
    return after, changes, opened


_CHANGES = "part int, row bigint, file_id bigint, field_name string, change string"
_EDGES = ", n_files bigint, first_series bigint, last_series bigint, first_body string, last_body string, opened string, state string"
_ARROW = pa.schema([
    ("part", pa.int32()), ("row", pa.int64()), ("file_id", pa.int64()), ("field_name", pa.string()), ("change", pa.string()), ("n_files", pa.int64()),
    ("first_series", pa.int64()), ("last_series", pa.int64()), ("first_body", pa.string()), ("last_body", pa.string()), ("opened", pa.string()), ("state", pa.string()),
])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW], schema=_ARROW)


def walk_files(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """All files in order, partition by partition: a row per change found there, and a row (with n_files) per partition.

    The row of a partition has its ends, the retypings left open, and the state after its last file.
    """
    order = ["series_id", "exported_at", "file_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, found, edge = TaskContext.get().partitionId(), 0, [], {}
        before: tuple[int | None, Export] | None = None
        state: dict[str, object] = {}
        opened: list[tuple] = []
        for batch in batches:
            for p in slices(batch, 256):
                exports = [parse_export(b) for b in p["body"].to_pylist()]
                for series, file_id, now, kinds in zip(p["series_id"].to_pylist(), p["file_id"].to_pylist(), exports, kinds_of(exports)):
                    if before is None:
                        edge = {"part": part, "file_id": file_id, "first_series": series, "first_body": p["body"][0].as_py()}
                        state = {n: k or n for n, k in kinds.items()}
                    else:
                        state, changes, still = step(state, compare(now, kinds, before[1] if series == before[0] else None))
                        found += [{"part": part, "row": row, "file_id": file_id, "field_name": n, "change": c} for n, c in changes]
                        opened += [(row, file_id, *x) for x in still]
                    before, row = (series, now), row + 1
                last_body = p["body"][-1]
                if len(found) >= 10_000:
                    yield _rows(found)
                    found = []
        if before is not None:
            edge |= {"n_files": row, "last_series": before[0], "last_body": last_body.as_py(), "opened": json.dumps(opened), "state": json.dumps(state)}
            yield _rows([*found, edge])

    ordered = files.select(*order, "body").repartitionByRange(partitions or shuffle_partitions(files.sparkSession), *order)
    return ordered.sortWithinPartitions(*order, "body").select("series_id", "file_id", "body").mapInArrow(run, _CHANGES + _EDGES)


def schema_changes(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """The ordered differences of all files: (file_id, seq, field_name, change), seq being a file's place in the order."""
    spark = files.sparkSession
    walked = materialize(walk_files(files, partitions), "drift")
    edges = walked.where("n_files IS NOT NULL")
    known = sorted(map(tuple, edges.select("part", "n_files").collect()))  # numbers, two per partition
    starts, at = [], 0
    for i, (part, n) in enumerate(known):
        starts.append((part, known[i - 1][0] if i else None, at))
        at += n
    places = spark.createDataFrame(starts, "part int, part_before int, start bigint")
    tails = edges.select(F.col("part").alias("part_before"), F.col("last_series").alias("series_before"), F.col("last_body").alias("body_before"))
    heads = edges.join(F.broadcast(places), "part").join(tails, "part_before", "left")
    first = F.col("part_before").isNull() | ~F.col("first_series").eqNullSafe(F.col("series_before"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in slices(batch, 16):
                now = [parse_export(b) for b in p["first_body"].to_pylist()]
                old = [None if f else parse_export(b) for f, b in zip(p["first"].to_pylist(), p["body_before"].to_pylist())]
                digests = [json.dumps(compare(a, k, b)) for a, k, b in zip(now, kinds_of(now), old)]
                yield pa.RecordBatch.from_arrays([p["part"], p["file_id"], p["opened"], p["state"], pa.array(digests, pa.string())], names=["part", "file_id", "opened", "state", "digest"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, object] = {}
        for batch in batches:
            for p in slices(batch, 16):
                found = []
                for part, file_id, opened, after_all, digest in zip(*(p[c].to_pylist() for c in ("part", "file_id", "opened", "state", "digest"))):
                    after, changes, _ = step(state, json.loads(digest))
                    found += [(part, 0, file_id, n, c) for n, c in changes]
                    found += [(part, row, f, n, "retyped") for row, f, n, kind, head in json.loads(opened) if after[head] and after[head] != kind]
                    state = {n: after[k] if isinstance(k, str) else k for n, k in json.loads(after_all).items()}
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], _ARROW.field(i).type) for i in range(5)], names=_ARROW.names[:5])

    compared = heads.select("part", "file_id", "first_body", first.alias("first"), "body_before", "opened", "state").mapInArrow(
        ends, "part int, file_id bigint, opened string, state string, digest string"
    )
    # one row per partition, streamed in order: what fields have become until then goes along
    open_changes = compared.repartition(1).sortWithinPartitions("part").mapInArrow(chained, _CHANGES)
    columns = ["part", "row", "file_id", "field_name", "change"]
    all_changes = walked.where("n_files IS NULL").select(*columns).unionByName(open_changes)
    return all_changes.join(F.broadcast(places), "part").select("file_id", (F.col("start") + F.col("row")).alias("seq"), "field_name", "change")


def _whole(cell: str) -> int | None:
    digits = cell.lstrip("-").lstrip("0") or "0"
    value = int(digits) * (-1 if cell[0] == "-" else 1) if len(digits) <= 19 else 1 << 63
    return value if -(1 << 63) <= value < 1 << 63 else None


def too_long(cells: Cells) -> np.ndarray:
    """Which cells are whole numbers without a 64-bit integer, or other numbers without a finite double."""
    out = np.zeros(len(cells.texts), bool)
    size = pc.binary_length(cells.texts).to_numpy(zero_copy_only=False)
    with_power = pc.match_substring_regex(cells.texts, "[eE]").to_numpy(zero_copy_only=False)
    for i in np.flatnonzero((cells.whole & (size > 18)) | (cells.number & ~cells.whole & (with_power | (size > 300)))).tolist():
        cell = cells.texts[i].as_py()
        out[i] = _whole(cell) is None if cells.whole[i] else math.isinf(float(cell))
    return out


def union_columns(files: DataFrame) -> list[tuple[str, str, list[str]]]:
    """The columns of the one consistent table: name, kind (the join of all files' kinds in the lattice) and the fields they hold.

    Fields that differ in case only share a column under the smallest spelling, unless some file has several of them: then each
    is a column of its own, numbered where names must differ in more than case. Numbers too long for 64 bits make a column text.
    One row per distinct field name reaches the driver, as it must to name the columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widest: dict[str, int] = {}
        twins: set[str] = set()
        for batch in batches:
            for p in slices(batch, 256):
                exports = [parse_export(b) for b in p["body"].to_pylist()]
                cells = cells_of(exports)
                kinds = iter(cells.widest(np.where(too_long(cells), 3, cells.rank)).tolist())
                for e in exports:
                    spellings = Counter(n.lower() for n in e.names)
                    twins.update(n for n in e.names if spellings[n.lower()] > 1)
                    for n in e.names:
                        widest[n] = max(widest.get(n, 0), next(kinds))
        if widest:
            yield pa.RecordBatch.from_arrays([pa.array(list(widest)), pa.array(list(widest.values()), pa.int32()), pa.array([n in twins for n in widest])], names=["name", "kind", "twin"])

    found = files.select("body").mapInArrow(run, "name string, kind int, twin boolean").groupBy("name").agg(F.max("kind").alias("kind"), F.bool_or("twin").alias("twin")).collect()
    folded: dict[str, list] = {}
    for r in sorted(found, key=lambda r: r["name"]):
        folded.setdefault(r["name"].lower(), []).append(r)
    taken, out = set(folded), []
    for rows in folded.values():
        if not any(r["twin"] for r in rows):
            out.append((rows[0]["name"], KINDS[max(r["kind"] for r in rows)], [r["name"] for r in rows]))
            continue
        for k, r in enumerate(rows):
            name = r["name"] if not k else next(x for i in count(1) if (x := f"{r['name']}_{i}").lower() not in taken)
            taken.add(name.lower())
            out.append((name, KINDS[r["kind"]], [r["name"]]))
    return sorted(out)


def cast_cells(cells: list[str | None], kind: str) -> pa.Array:
    """Cells as values of a kind; blank and missing ones are null."""
    texts = pa.array(cells, pa.large_string())
    texts = pc.if_else(pc.match_substring_regex(texts, NOT_BLANK), texts, pa.scalar(None, texts.type))
    if kind in ("none", "text"):
        return texts.cast(pa.string())
    if kind == "whole":
        return pc.replace_substring_regex(texts, "^(-?)0+([0-9])", r"\1\2").cast(pa.int64())
    return pc.replace_substring_regex(texts, r"\.$|\.([eE])", r"\1").cast(pa.float64())


def consistent_table(files: DataFrame) -> DataFrame:
    """Every record of every file under the union schema, with its file_id; blank cells are null."""
    fields = union_columns(files)
    types = {"none": "string", "whole": "bigint", "number": "double", "text": "string"}
    names = [n for n, _, _ in fields]
    taken = {n.lower() for n in names}
    id_name = next(x for x in ("file_id", *(f"file_id_{i}" for i in range(1, len(taken) + 2))) if x.lower() not in taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in slices(batch, 256):
                exports = [parse_export(b) for b in p["body"].to_pylist()]
                ids = p["file_id"].take(pa.array(np.repeat(np.arange(len(exports)), [e.n for e in exports])))
                columns = []
                for _, kind, held in fields:
                    cells: list[str | None] = []
                    for e in exports:
                        i = next((e.place[n] for n in held if n in e.place), None)
                        cells += [None] * e.n if i is None else e.columns[i]
                    columns.append(cast_cells(cells, kind))
                yield pa.RecordBatch.from_arrays([ids, *columns], names=[id_name, *names])

    schema = ", ".join([f"`{id_name}` bigint", *(f"`{n.replace('`', '``')}` {types[k]}" for n, k, _ in fields)])
    return files.select("file_id", "body").mapInArrow(run, schema)
