"""CSV files as typed DataFrames, and the records in them that fail to parse.

One job reads the headers. A second goes once over all bytes, in blocks of large files: quotes are
counted by block, their parity tells where records begin and end, and each task splits the records that
begin in its block by the structural index of :mod:`profloom.operators.rejects`. It finds the kinds of all columns, the records of
broken quoting or of a wrong number of fields, and the files with line breaks within fields. The rows
themselves are then scanned by Spark, file by file only where there are such line breaks.

Malformed files, which have a record that fails, are left out as a whole with a warning; or, with
``malformed="rows"``, such records alone are left out, and :func:`rejected_records` gives them with their reasons.

Defined cases: blank lines are no records; one CR at the end of a record isn't part of it; a byte-order mark is dropped; bytes that
aren't UTF-8 read as U+FFFD, in a header they make the file unreadable; where a record of broken quoting has line breaks, each of its
lines is taken for a record; empty fields are null, quoted ones too; of equal column names later ones are numbered.
"""

from __future__ import annotations

import csv
import io
import json
import logging
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import NativeFile
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from profloom.errors import NoInputDataException
from profloom.functions.naming import distinct_names, quoted
from profloom.functions.types import common_schema, conform
from profloom.operators.rejects import Structure, structural_index
from profloom.sources import storage
from profloom.sources.discovery import Source

log = logging.getLogger(__name__)
csv.field_size_limit((1 << 31) - 1)  # cells may be very long

# Texts of each type, narrowest first; all-blank columns have none.
KINDS: tuple[tuple[str, T.DataType], ...] = (
    (r"^[+-]?[0-9]{1,18}$", T.LongType()),
    (r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?(nan|NaN|NAN|inf|Infinity|-inf))$", T.DoubleType()),
    (r"^(true|false|True|False|TRUE|FALSE)$", T.BooleanType()),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?)?$", T.TimestampNTZType()),
)
BLOCK = 16 << 20  # bytes of a file per task
CHUNK = 8 << 20  # bytes that are split at once
LONGEST = 64 << 20  # bytes after which a record that doesn't end is taken for lines

QUOTING, COLUMNS = "quoting", "columns"  # reasons


@dataclass(frozen=True)
class Headed:
    """Files of one header."""

    names: tuple[str, ...]
    files: tuple[Source, ...]
    schema: T.StructType
    broken_lines: frozenset[str]  # paths of files with line breaks within fields


# -- headers


def first_record(path: str, at: storage.Locate = storage.locate) -> tuple[list[str], int]:
    """Distinct column names of a file's first record, and the file's size."""
    system, place = at(path)
    size, head, quotes, seen = system.get_file_info(place).size or 0, b"", 0, 0
    with system.open_input_stream(place) as f:
        while block := f.read(1 << 16):
            head += block
            while (end := head.find(b"\n", seen)) >= 0:
                quotes += head.count(b'"', seen, end)
                seen = end + 1
                if not quotes % 2:
                    break
            if end >= 0 or len(head) > LONGEST:
                break
    text = (head[:end] if 0 <= (end := seen - 1) else head).decode("utf-8-sig").removesuffix("\r")
    return distinct_names(next(csv.reader(io.StringIO(text, newline="")), [])), size


def by_header(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(header, path, place, size) of every file in one job; header is null where it can't be read."""
    at = storage.resolver()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch["path"].to_pylist():
                try:
                    names, size = first_record(path, at)
                    found.append((json.dumps(names) if names else None, size))
                except (csv.Error, UnicodeDecodeError, OSError):
                    found.append((None, 0))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), batch["path"], batch["place"], pa.array([n for _, n in found], pa.int64())], names=["header", "path", "place", "size"])

    frame = spark.createDataFrame(list(zip(paths, range(len(paths)))), "path string, place bigint")
    return frame.repartition(min(len(paths), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "header string, path string, place bigint, size bigint")


# -- records


def _ends(data: bytes, odd: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of all line ends in ``data``, and whether the number of quotes before each is even."""
    signs = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(signs == 10)
    quotes = np.flatnonzero(signs == 34)
    return at, (np.searchsorted(quotes, at) + odd) % 2 == 0


def _first_start(f: NativeFile, start: int, end: int, odd: bool) -> int | None:
    """Where the first record begins from ``start`` up to ``end``."""
    if not start:
        return 0
    f.seek(start - 1)
    if f.read(1) == b"\n" and not odd:
        return start
    while start < end and (block := f.read(min(CHUNK, end - start))):
        at, even = _ends(block, odd)
        if even.any():
            found = start + int(at[even][0]) + 1
            return found if found < end else None
        odd ^= bool(block.count(b'"') % 2)
        start += len(block)
    return None


def record_chunks(path: str, start: int, end: int, odd: bool, at: storage.Locate = storage.locate) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(byte offsets, texts) of the records that begin from ``start`` up to ``end``; ``odd``: the quotes before ``start`` are odd in number.

    The last record is read on to its end. One without an end within LONGEST bytes is given line by line.
    """
    system, place = at(path)
    with system.open_input_file(place) as f:
        pos = _first_start(f, start, end, odd)
        if pos is None:
            return
        f.seek(pos)
        held, lines, odd = b"", False, False
        while True:
            block = f.read(CHUNK if pos + len(held) < end else max(1 << 16, len(held)))
            data = held + block
            places, even = _ends(data, odd)
            closed = int(places[even][0]) if even.any() else None  # the first end of a record
            lines = lines or (closed is None and len(data) > LONGEST)
            ends = places[even] if not lines else places if closed is None else places[places <= closed]
            starts = np.concatenate([[0], ends + 1]).astype(np.int64)
            if not block and starts[-1] < len(data):
                ends = np.append(ends, len(data))  # the last record, without a line end
            starts = starts[: len(ends)]
            own = np.ones(len(starts), bool) if lines else pos + starts < end  # the lines of a record are its task's
            if own.any():
                yield pos + starts[own], _texts(data, starts[own], ends[own])
            if not block or not own.all():
                return
            if len(ends):
                cut = int(ends[-1]) + 1
                if lines:
                    lines = closed is None
                    odd = lines and bool((data.count(b'"', 0, cut) + odd) % 2)
                data, pos = data[cut:], pos + cut
                if pos >= end and not lines:
                    return
            held = data


def _texts(data: bytes, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The parts of ``data`` as texts, without the signs between them."""
    first, last = int(starts[0]), int(stops[-1])
    keep = np.ones(last - first, bool)
    keep[stops[:-1] - first] = False
    part = np.frombuffer(data, np.uint8, last - first, first)[keep].tobytes()
    offsets = np.append(starts - first - np.arange(len(starts)), len(part)).astype(np.int64)
    try:
        part.decode()
    except UnicodeDecodeError:
        return pa.array([part[a:b].decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])], pa.large_string())
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(part))


@dataclass
class Judged:
    """Records of one file: where they begin, their texts, fields, and the reason ('' if valid)."""

    offsets: np.ndarray
    texts: pa.Array
    structure: Structure
    reason: np.ndarray


def judge(offsets: np.ndarray, texts: pa.Array, width: int) -> Iterator[Judged]:
    """Records with their reasons; blank lines drop out, and broken records of several lines are judged line by line."""
    filled = pc.match_substring_regex(texts, "[^\r]").to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 1)
    if not filled.all():
        offsets, texts = offsets[filled], texts.filter(pa.array(filled))
    s = structural_index(texts)
    torn = s.broken & pc.match_substring(texts, "\n").to_numpy(zero_copy_only=False)
    reason = np.where(s.broken, QUOTING, np.where(np.diff(s.first) != width, COLUMNS, "")).astype(object)
    if not torn.any():
        if len(texts):
            yield Judged(offsets, texts, s, reason)
        return
    if not torn.all():
        yield from judge(offsets[~torn], texts.filter(pa.array(~torn)), width)
    where, lines = [], []
    for at, text in zip(offsets[torn].tolist(), texts.filter(pa.array(torn)).to_pylist()):
        for line in text.split("\n"):
            where.append(at)
            lines.append(line)
            at += len(line.encode()) + 1
    yield from judge(np.array(where, np.int64), pa.array(lines, pa.large_string()), width)


def _kind_of(column: pa.Array) -> int:
    """A bit for each kind that some text of the column has."""
    left = column.filter(pc.fill_null(pc.greater(pc.binary_length(column), 0), False))
    bits = 0
    for i, (pattern, _) in enumerate(KINDS):
        if not len(left):
            return bits
        hit = pc.match_substring_regex(left, pattern)
        if pc.any(hit).as_py():
            bits |= 1 << i
            left = left.filter(pc.invert(hit))
    return bits | (1 << len(KINDS)) if len(left) else bits


def _blocks(files: DataFrame, most: int, n: int) -> DataFrame:
    """(header, path, width, start, end, odd, whole) of all ``n`` blocks of files (header, path, width, size), of which the largest has ``most`` bytes."""
    spark = files.sparkSession
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(BLOCK).cast("bigint"))
    blocks = files.withColumn("start", F.explode(starts)).select(
        "header", "path", "width", "start", F.least(F.col("start") + BLOCK, "size").alias("end"), (F.col("size") <= BLOCK).alias("whole")
    ).repartition(min(n, max(4 * spark.sparkContext.defaultParallelism, n // 16)))
    if most <= BLOCK:
        return blocks.withColumn("odd", F.lit(False))
    at = storage.resolver()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for path, start, end, whole in zip(*(batch[c].to_pylist() for c in ("path", "start", "end", "whole"))):
                n = 0
                if not whole:
                    system, place = at(path)
                    with system.open_input_file(place) as f:
                        f.seek(start)
                        while start < end and (block := f.read(min(CHUNK, end - start))):
                            n += block.count(b'"')
                            start += len(block)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "quotes"])

    counted = blocks.mapInArrow(run, "header int, path string, width int, start bigint, end bigint, whole boolean, quotes bigint")
    before = F.sum("quotes").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))  # a row per block
    return counted.withColumn("odd", F.coalesce(before, F.lit(0)) % 2 == 1).drop("quotes")


def _judged(batch: pa.RecordBatch, at: storage.Locate) -> Iterator[tuple[dict, Iterator[Judged]]]:
    for block in batch.to_pylist():

        def records(b: dict = block) -> Iterator[Judged]:
            for offsets, texts in record_chunks(b["path"], b["start"], b["end"], b["odd"], at):
                if len(offsets) and offsets[0] == 0:
                    offsets, texts = offsets[1:], texts.slice(1)  # the header
                if len(offsets):
                    yield from judge(offsets, texts, b["width"])

        yield block, records()


def _columns(j: Judged, rows: np.ndarray, width: int) -> Iterator[pa.Array]:
    for k in range(width):
        yield j.structure.values.take(pa.array(j.structure.first[rows] + k))


def inspect(spark: SparkSession, sources: Sequence[Source], malformed: str = "files") -> list[Headed]:
    """The sources by header, in their order, with their inferred schemas; what can't be read is left out and reported."""
    if malformed not in ("files", "rows"):
        raise ValueError("malformed must be files or rows")
    at, by_path = storage.resolver(), {s.path: s for s in sources}
    headers = by_header(spark, [s.path for s in sources])
    groups = headers.groupBy("header").agg(F.collect_list(F.struct("place", "path", "size")).alias("files")).collect()  # the files, and each header once
    for r in groups:
        if r["header"] is None:
            for f in r["files"]:
                log.warning("%s can't be read and is left out", f["path"])
    known = sorted(([json.loads(r["header"]), sorted(r["files"], key=lambda f: f["place"])] for r in groups if r["header"] is not None), key=lambda x: x[1][0]["place"])
    if not known:
        raise NoInputDataException("none of the files can be read")
    listed = [(i, f["path"], len(names), f["size"]) for i, (names, files) in enumerate(known) for f in files]
    sizes = [x[3] for x in listed]
    blocks = _blocks(spark.createDataFrame(listed, "header int, path string, width int, size bigint"), max(sizes), sum(max(1, -(-n // BLOCK)) for n in sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        rows: list[tuple] = []
        for batch in batches:
            for block, records in _judged(batch, at):
                bits, bad, breaks = np.zeros(block["width"], np.int32), False, False
                for j in records:
                    valid = np.flatnonzero(j.reason == "")
                    bad |= len(valid) < len(j.reason)
                    breaks = breaks or bool(pc.any(pc.match_substring_regex(j.texts.take(pa.array(valid)), "(?s)\n|\r.")).as_py())
                    bits |= np.fromiter(map(_kind_of, _columns(j, valid, block["width"])), np.int32, block["width"])
                if block["whole"] and (malformed == "rows" or not bad):
                    have = whole.setdefault(block["header"], np.zeros(block["width"], np.int32))
                    have |= bits
                    bits = None
                if bits is not None or breaks or bad:
                    rows.append((block["header"], block["path"], None if bits is None else bits.tolist(), bad, breaks))
        rows += [(h, None, b.tolist(), False, False) for h, b in whole.items()]
        kinds = (pa.int32(), pa.string(), pa.list_(pa.int32()), pa.bool_(), pa.bool_())
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + 64]], k) for c, k in enumerate(kinds)], names=["header", "path", "bits", "bad", "breaks"])

    # files of one block are settled where they are read: a row per task and header, and one for each file that is large, malformed or has line breaks
    seen = blocks.mapInArrow(run, "header int, path string, bits array<int>, bad boolean, breaks boolean").persist()
    try:
        marks = seen.where("path IS NOT NULL").groupBy("path").agg(F.bool_or("bad").alias("bad"), F.bool_or("breaks").alias("breaks")).where("bad OR breaks").collect()
        left_out = {r["path"] for r in marks if r["bad"]} if malformed == "files" else set()
        skipped = spark.createDataFrame([(p,) for p in left_out], "path string")
        kept = seen.join(skipped, "path", "left_anti") if left_out else seen
        merged = kept.where("bits IS NOT NULL").select("header", F.posexplode("bits").alias("column", "bits")).groupBy("header", "column").agg(F.bit_or("bits").alias("bits"))
        bits: dict[int, dict[int, int]] = {}
        for r in merged.collect():  # one row per column of each header
            bits.setdefault(r["header"], {})[r["column"]] = r["bits"]
    finally:
        seen.unpersist()
    for p in sorted(left_out):
        log.warning("%s has records that aren't well formed and is left out", p)
    out = []
    for i, (names, files) in enumerate(known):
        kept_files = tuple(by_path[f["path"]] for f in files if f["path"] not in left_out)
        if kept_files:
            schema = T.StructType([T.StructField(n, type_of(bits.get(i, {}).get(k, 0))) for k, n in enumerate(names)])
            own = {s.path for s in kept_files}
            out.append(Headed(tuple(names), kept_files, schema, frozenset(r["path"] for r in marks if r["breaks"] and r["path"] in own)))
    if not out:
        raise NoInputDataException("none of the files can be read")
    return out


def _where(mask: np.ndarray, values: pa.Array) -> pa.Array:
    """The values where ``mask`` holds, null elsewhere."""
    return values.take(pa.array(np.arange(len(mask)), mask=~mask))


def split_records(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """Every record of files of readable headers: (path, at, names, reason, raw, fields); valid ones have no reason and no raw text."""
    at = storage.resolver()
    headers = by_header(spark, [s.path for s in sources]).where("header IS NOT NULL")
    files = headers.select(F.lit(0).alias("header"), "path", F.json_array_length("header").alias("width"), "size")
    about = files.agg(F.coalesce(F.max("size"), F.lit(0)).alias("most"), F.coalesce(F.sum(F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK))), F.lit(1)).alias("n")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, records in _judged(batch, at):
                for j in records:
                    n = len(j.reason)
                    lists = pa.ListArray.from_arrays(pa.array(j.structure.first.astype(np.int32)), j.structure.values.cast(pa.string()))
                    columns = [
                        pa.array([block["path"]] * n, pa.string()), pa.array(j.offsets, pa.int64()), pa.array([r or None for r in j.reason], pa.string()),
                        _where(j.reason != "", j.texts).cast(pa.string()), _where(j.reason == "", lists),
                    ]
                    whole = pa.RecordBatch.from_arrays(columns, names=["path", "at", "reason", "raw", "fields"])
                    for i in range(0, n, 4096):
                        yield whole.slice(i, 4096)

    return _blocks(files, about["most"], max(1, int(about["n"]))).mapInArrow(run, "path string, at bigint, reason string, raw string, fields array<string>")


def rejected_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, at, reason, raw) of the records that fail to parse; ``at`` is the byte at which a record begins."""
    return split_records(spark, [Source(p) for p in paths]).where("reason IS NOT NULL").select("path", "at", "reason", "raw")


# -- typed rows


def _raw(spark: SparkSession, headed: Headed) -> DataFrame:
    """The texts of the files with their path: files without line breaks in fields are read in parts, the others each by one task."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in headed.names])
    reader = spark.read.schema(schema).options(header=True, sep=",", quote='"', escape='"', enforceSchema=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False)
    several = [s.path for s in headed.files if s.path in headed.broken_lines]
    single = [s.path for s in headed.files if s.path not in headed.broken_lines]
    parts = [reader.option("multiLine", lines).csv(paths).select("*", _place().alias("__path")) for lines, paths in ((False, single), (True, several)) if paths]
    return reduce(DataFrame.unionByName, parts)


def _place() -> Column:
    """The path of a row's file."""
    return F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", "^file:/+", "/"), F.lit("+"), F.lit("%2B")))


def type_of(bits: int) -> T.DataType:
    """The narrowest type that holds all kinds; mixed kinds other than numbers are text."""
    if not bits:
        return T.NullType()
    alone = {1 << i: t for i, (_, t) in enumerate(KINDS)}
    return alone.get(bits, T.DoubleType() if bits == 0b11 else T.StringType())


def scan_files(spark: SparkSession, headed: Headed, schema: T.StructType, numbers: DataFrame | None = None, malformed: str = "files") -> DataFrame:
    """Files of one header under ``schema``, a subset of their columns.

    With ``numbers`` (path, TableNumber) each row also gets its file's table number, as first column.
    """
    if malformed == "rows" or any(storage.is_registered(s.path) for s in headed.files):
        rows = split_records(spark, headed.files).where("reason IS NULL")
        raw = rows.selectExpr(*(f"get(fields, {i}) AS {quoted(n)}" for i, n in enumerate(headed.names)), "path AS __path")
    else:
        raw = _raw(spark, headed)
    if numbers is not None:
        raw = raw.join(numbers.withColumnRenamed("path", "__path"), "__path", "left")
        schema = T.StructType([T.StructField("TableNumber", T.LongType()), *(f for f in schema.fields if f.name != "TableNumber")])
    # blank texts are null; blank numbers are when they are cast, and `nan` and `inf` are numbers to the cast
    texts = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)}
    cleaned = raw.selectExpr(*(f"nullif({quoted(n)}, '') AS {quoted(n)}" if n in texts else quoted(n) for n in schema.names))
    return conform(cleaned, schema)


def read_csv(spark: SparkSession, paths: Sequence[str], malformed: str = "files") -> DataFrame:
    """All files as one table of the columns they share, in harmonized types."""
    known = inspect(spark, [Source(p) for p in paths], malformed)
    schema, dropped = common_schema([h.schema for h in known])
    if dropped:
        log.warning("columns that not all files have are left out: %s", ", ".join(dropped))
    return reduce(DataFrame.unionByName, [scan_files(spark, h, schema, malformed=malformed) for h in known])
