"""Far too many small files: consolidate tiny delimited files into a few well-sized ones.

1. *Schedule.* Files are assigned to a fixed number of output groups, as many as their bytes fill at
   the target size, longest first, each to the least-loaded group of a heap. Very long file lists are
   first spread by hash over lanes of bounded length, each with its own share of the groups, so no
   task holds the whole list.
2. *Stream.* Each group's files run through pyarrow as record batches, in several tasks where there are
   fewer groups than partitions; records that repeat within a batch are marked at once, so that
   however often one record occurs, only one copy a batch goes on to the exchange by record.
3. *Publish.* Groups are written under a name no other attempt uses; row counts are verified against
   the parquet footers and the records read, then one rename makes the manifest visible.

Defined cases: the header is the first line that isn't blank; a line with fewer fields than it is no
record, nor is a blank line; a null or empty body has no records; a byte-order mark is dropped; null,
blank and unreadable numbers are null, which equals null, and NaN equals NaN; of repeated records the
one of smallest (file_id, line_no) stays; a null file_id comes before all others; rows of one file_id
are files of their own, of which one keeps its records and the others' count as repeats.
"""

from __future__ import annotations

import csv
import heapq
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from profloom.runtime import slices

csv.field_size_limit((1 << 31) - 1)  # cells may be very long

RECORD = ("ImageNumber", "ObjectNumber", "c0")
KEY = ("table_number", "image_number", "object_number", "c0")
TARGET_BYTES = 512 << 20  # of delimited text in an output group: about 100 MB of Parquet
BROADCAST_BYTES = 4 << 20  # up to which the assignment of files to groups, 16 bytes a file, is broadcast
BATCH_RECORDS = 500_000  # within which repeats are marked before the exchange
PARSED = "group_id bigint, file_id bigint, line_no bigint, table_number bigint, image_number double, object_number double, c0 double, repeats boolean"


def longest_first(sizes: list[int], n_groups: int) -> list[int]:
    """The group of each item: by falling size, each to the group with the least load so far."""
    heap = [(0, g) for g in range(n_groups)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return out


def assign_groups(files: DataFrame, target_bytes: int = TARGET_BYTES, lane_files: int = 200_000) -> tuple[DataFrame, int, int]:
    """(file_id, n_bytes) → (file_id, group_id), the number of files and that of groups; lanes hold about ``lane_files`` files each."""
    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest("n_bytes", F.lit(0))), F.lit(0)).alias("b")).first()
    lanes = max(1, min(-(-total["n"] // lane_files), -(-total["b"] // target_bytes)))
    per_lane = max(1, -(-total["b"] // target_bytes // lanes))

    def pack(key: tuple, lane: pd.DataFrame) -> pd.DataFrame:
        lane = lane.sort_values("file_id", kind="stable")
        group = longest_first(lane["n_bytes"].fillna(0).astype("int64").tolist(), per_lane)
        return pd.DataFrame({"file_id": lane["file_id"], "group_id": np.asarray(group, dtype="int64") + int(key[0]) * per_lane})

    lane = F.pmod(F.xxhash64("file_id"), F.lit(lanes)).alias("lane")
    return files.select("file_id", "n_bytes", lane).groupBy("lane").applyInPandas(pack, "file_id bigint, group_id bigint"), total["n"], lanes * per_lane


def _split(line: str) -> list[str]:
    return next(csv.reader([line]), []) if '"' in line else line.split(",")


def _numbers(texts: pa.Array) -> np.ndarray:
    return pd.to_numeric(pd.Series(texts.to_pylist(), dtype=object), errors="coerce").to_numpy(dtype="float64", na_value=np.nan)


def parse_bodies(file_ids: pa.Array, tables: pa.Array, bodies: pa.Array, groups: pa.Array) -> pa.Table:
    """The records of a batch of small delimited files, as columns."""
    bodies = pc.fill_null(bodies.cast(pa.large_string()), "")
    bodies = pc.replace_substring_regex(pc.replace_substring_regex(bodies, "^﻿", ""), "\r\n?", "\n")
    listed = pc.split_pattern(bodies, "\n")
    starts = listed.offsets.to_numpy().astype(np.int64)
    lines, owner = listed.flatten(), pc.list_parent_indices(listed).to_numpy()
    starts = starts - starts[0]
    line_no = np.arange(len(lines)) - starts[owner] + 1
    blank = np.asarray(pc.equal(pc.binary_length(pc.utf8_trim_whitespace(lines)), 0))
    n_files = len(bodies)

    header = np.full(n_files, -1, np.int64)
    filled = np.flatnonzero(~blank)
    header[owner[filled][::-1]] = filled[::-1]  # the first filled line of each file is assigned last
    has = np.flatnonzero(header >= 0)
    width = np.full(n_files, np.iinfo(np.int64).max // 2)
    where = np.full((n_files, len(RECORD)), -1, np.int64)
    heads = pc.dictionary_encode(lines.take(pa.array(header[has])))
    shapes = []
    for text in heads.dictionary.to_pylist():
        names = [x.strip() for x in _split(text)]
        shapes.append([len(names), *(names.index(c) if c in names else -1 for c in RECORD)])
    if len(has):
        shape = np.array(shapes, np.int64)[heads.indices.to_numpy()]
        width[has], where[has] = shape[:, 0], shape[:, 1:]

    rows = np.flatnonzero(~blank & (np.arange(len(lines)) > header[owner]) & (header[owner] >= 0))
    texts = lines.take(pa.array(rows))
    quoted = np.asarray(pc.match_substring(texts, '"'))
    hard = np.flatnonzero(quoted & np.asarray(pc.match_substring_regex(texts, '(^|,)"[^",]*,')))  # a delimiter in quotes
    easy = np.setdiff1d(np.arange(len(rows)), hard, assume_unique=True)
    fields = pc.split_pattern(pc.replace_substring(texts.take(pa.array(easy)), '"', ""), ",")
    flat, begin = fields.flatten(), fields.offsets.to_numpy().astype(np.int64)
    begin = begin - begin[0]
    if len(hard):
        split = [_split(x) for x in texts.take(pa.array(hard)).to_pylist()]
        flat = pa.concat_arrays([flat, pa.array([x for f in split for x in f], flat.type)])
        begin = np.concatenate([begin, begin[-1] + np.cumsum([len(f) for f in split])])
    order = np.concatenate([easy, hard])
    rows, n_fields, begin = rows[order], np.diff(begin), begin[:-1]
    whole = n_fields >= width[owner[rows]]
    rows, begin = rows[whole], begin[whole]
    own = owner[rows]

    columns = []
    for k in range(len(RECORD)):
        at = where[own, k]
        cell = pc.utf8_trim_whitespace(flat.take(pa.array(np.where(at >= 0, begin + at, 0)))) if len(rows) else pa.array([], pa.large_string())
        number = _numbers(cell)
        is_nan = np.asarray(pc.match_substring_regex(cell, "^[+-]?[nN][aA][nN]$"), dtype=bool) & (at >= 0)
        none = (np.isnan(number) & ~is_nan) | (at < 0)
        columns.append(pa.array(np.where(none, 0.0, number) + 0.0, mask=none))  # + 0.0: no negative zero
    return pa.table(
        [groups.take(pa.array(own)), file_ids.take(pa.array(own)), pa.array(line_no[rows]), tables.take(pa.array(own)), *columns],
        names=["group_id", "file_id", "line_no", "table_number", "image_number", "object_number", "c0"],
    )


def _mark_repeats(records: pa.Table) -> pa.Table:
    """Mark those records of a batch that repeat one of smaller (file_id, line_no) in it."""
    # pandas takes NaN and null for one value, so null is told apart by columns of its own
    keys = {c: pc.fill_null(records[c], 0).to_numpy() for c in KEY}
    keys |= {"no_" + c: pc.is_null(records[c]).to_numpy() for c in KEY}
    first_nulls = pc.fill_null(records["file_id"], np.iinfo(np.int64).min).to_numpy()
    order = np.lexsort((records["line_no"].to_numpy(), first_nulls))
    repeats = np.zeros(records.num_rows, bool)
    repeats[order] = pd.DataFrame(keys).iloc[order].duplicated().to_numpy()
    return records.append_column("repeats", pa.array(repeats))


def parse_groups(files: DataFrame, assigned: DataFrame, n_partitions: int, n_groups: int = 1, small: bool = False) -> DataFrame:
    """Every record of the files, streamed group by group through pyarrow. Files without id are in group 0.

    If the assignment is ``small`` (at most BROADCAST_BYTES), it is broadcast and the bodies move once, to
    their group; else bodies and groups first meet by file. A group is streamed by as many tasks as
    there are partitions for it.
    """
    shards = max(1, n_partitions // n_groups)

    def flush(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if held:
            yield from _mark_repeats(pa.concat_tables(held).combine_chunks()).to_batches(65_536)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for part in slices(batch, 2048):
                held.append(parse_bodies(*(part.column(i) for i in range(4))))
                rows += held[-1].num_rows
                if rows >= BATCH_RECORDS:
                    yield from flush(held)
                    held, rows = [], 0
        yield from flush(held)

    placed = assigned.where(F.col("file_id").isNotNull()).dropDuplicates(["file_id"])
    return (
        files.select("file_id", "table_number", "body")
        .join(F.broadcast(placed) if small else placed, "file_id", "left")
        .select("file_id", "table_number", "body", F.coalesce("group_id", F.lit(0)).alias("group_id"))
        .repartition(n_partitions, "group_id", F.pmod(F.xxhash64("file_id"), F.lit(shards)))
        .sortWithinPartitions("group_id", "file_id")
        .mapInArrow(run, PARSED)
    )


def mark_copies(records: DataFrame) -> DataFrame:
    """Add ``copy``: whether a record repeats one of smaller (file_id, line_no) in any file.

    Records already known to repeat within their batch get a partition of their own each, so the
    exchange by record sees at most one copy per batch of even the most frequent record.
    """
    alone = [F.when(F.col("repeats"), F.col(c)) for c in ("file_id", "line_no")]
    first = Window.partitionBy(*KEY, "repeats", *alone).orderBy("file_id", "line_no")
    return records.withColumn("copy", F.col("repeats") | (F.row_number().over(first) > 1))


def small_file_records(files: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """All records of ``files`` (file_id, table_number, n_bytes, body) with output group and ``copy`` mark."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups, n_files, n_groups = assign_groups(files, target_bytes)
    return mark_copies(parse_groups(files, groups, n, n_groups, 16 * n_files <= BROADCAST_BYTES))


def dropped_records(records: DataFrame) -> DataFrame:
    """(file_id, line_no) of the record lines that are left out."""
    return records.where("copy").select("file_id", "line_no")


def publish(records: DataFrame, out: str, n_partitions: int) -> dict:
    """Write the records kept, one parquet file per group, and publish a verified manifest below ``out``.

    A task writes under a name of its own, so a repeated attempt never meets another's file; only files
    named in the manifest count. The manifest has one entry per output file and appears by one rename,
    after its row counts were checked against the parquet footers and against the records kept.
    """
    spark: SparkSession = records.sparkSession
    run = uuid.uuid4().hex
    columns = ["table_number", "image_number", "object_number", "c0"]
    schema = pa.schema([("table_number", pa.int64()), *((c, pa.float64()) for c in columns[1:])])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = fs.FileSystem.from_uri(out if "://" in out else f"file://{out}")
        filesystem.create_dir(root, recursive=True)
        attempt, group, writer, path, rows, done = uuid.uuid4().hex[:12], None, None, "", 0, []

        def close() -> None:
            if writer is not None:
                writer.close()
                with filesystem.open_input_file(f"{root}/{path}") as f:
                    footer = pq.ParquetFile(f).metadata.num_rows
                if footer != rows:
                    raise OSError(f"{path} holds {footer} rows, {rows} were written")
                done.append((group, path, rows, filesystem.get_file_info(f"{root}/{path}").size))

        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)] if len(ids) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if int(ids[a]) != group:
                    close()
                    group, rows = int(ids[a]), 0
                    path = f"part-{run}-{group:06d}-{attempt}.parquet"
                    writer = pq.ParquetWriter(filesystem.open_output_stream(f"{root}/{path}"), schema, compression="zstd")
                writer.write_batch(pa.RecordBatch.from_arrays([batch.column(i + 1).slice(a, b - a) for i in range(4)], schema=schema))
                rows += b - a
        close()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("group_id", "path", "n_rows", "n_bytes"), map(list, zip(*done)))))

    kept = records.where(~F.col("copy")).select("group_id", *columns, "file_id", "line_no")
    written = (
        kept.repartition(n_partitions, "group_id")
        .sortWithinPartitions("group_id", "file_id", "line_no")
        .select("group_id", *columns)
        .mapInArrow(write, T.StructType.fromDDL("group_id bigint, path string, n_rows bigint, n_bytes bigint"))
        .collect()  # one row per output file
    )
    manifest = {"run": run, "n_rows": sum(r["n_rows"] for r in written), "files": [r.asDict() for r in sorted(written, key=lambda r: r["group_id"])]}
    expected = kept.count()
    if manifest["n_rows"] != expected:
        raise OSError(f"{manifest['n_rows']} records were written, {expected} were to be")
    filesystem, root = fs.FileSystem.from_uri(out if "://" in out else f"file://{out}")
    filesystem.create_dir(root, recursive=True)
    with filesystem.open_output_stream(f"{root}/_manifest-{run}.tmp") as f:
        f.write(json.dumps(manifest).encode())
    filesystem.move(f"{root}/_manifest-{run}.tmp", f"{root}/_manifest.json")
    return manifest


def read_published(spark: SparkSession, out: str) -> DataFrame:
    """The records of the files that the manifest below ``out`` names."""
    filesystem, root = fs.FileSystem.from_uri(out if "://" in out else f"file://{out}")
    with filesystem.open_input_stream(f"{root}/_manifest.json") as f:
        files = [f"{out.rstrip('/')}/{x['path']}" for x in json.loads(f.read())["files"]]
    schema = "table_number bigint, image_number double, object_number double, c0 double"
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
