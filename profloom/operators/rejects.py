"""Rows that fail to parse: structural indexing of raw delimited records.

All records of a batch lie in one byte buffer. Quote masks and the prefix parity of the quotes
(counted from each record's start) locate the delimiters; checks on single quotes, on field
counts and on field values then make each record valid or rejected with its first reason.

Defined cases: one CR at the end of a record is dropped; an empty record has one empty field; a
null record and a record of an unknown (or null) file kind are rejected as ``columns``, unless
their quoting is broken; keys without a declared form are ``text``; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profloom.runtime import slices

# The forms that a field's value can have.
WHOLE = r"^-?[0-9]+$"
NUMBER = r"^(-?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[nN][aA][nN])$"
VERSION = r"^[0-9]+(\.[0-9]+){1,3}$"
CHANNEL = r"^(Grayscale|Color)$"
MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$"
FORBIDDEN = "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f�]"


@dataclass(frozen=True)
class Field:
    name: str
    form: str
    may_be_blank: bool


@dataclass(frozen=True)
class Layout:
    """The fields of each file kind, and the forms of ``by_key`` values by key. Both are small, fixed tables."""

    fields: dict[str, tuple[Field, ...]]
    key_forms: dict[str, str]


@dataclass
class Structure:
    """Fields of a batch: ``values`` holds them unquoted, record r has those from ``first[r]`` to ``first[r + 1]``."""

    values: pa.Array
    first: np.ndarray
    broken: np.ndarray


def structural_index(records: pa.Array) -> Structure:
    """Split the records of a string array into fields; ``broken`` marks those with broken quoting."""
    records = pc.fill_null(records.cast(pa.large_string()), "")
    n = len(records)
    offsets = np.frombuffer(records.buffers()[1], dtype=np.int64, count=n + 1, offset=records.offset * 8)
    size = int(offsets[-1] - offsets[0])
    data = np.frombuffer(records.buffers()[2], dtype=np.uint8, count=size, offset=int(offsets[0])) if size else np.zeros(0, np.uint8)
    start = offsets[:-1] - offsets[0]
    end = offsets[1:] - offsets[0]
    if size:
        last = data[np.maximum(end - 1, 0)]
        end = end - ((end > start) & (last == 13))

    inside = np.ones(size, bool)
    inside[end[end < offsets[1:] - offsets[0]]] = False  # the CR that a record ends with
    record = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    is_start = np.zeros(size + 1, bool)
    is_start[start[end > start]] = True
    is_end = np.zeros(size + 1, bool)  # at the first byte behind a record
    is_end[end] = True

    quote = (data == 34) & inside
    before = np.zeros(size + 1, np.int32 if size < 1 << 31 else np.int64)
    np.cumsum(quote, out=before[1:])
    odd = ((before[:-1] - before[start][record]) & 1).astype(bool) if size else np.zeros(0, bool)
    comma = (data == 44) & inside & ~odd
    prev_comma = np.zeros(size, bool)
    prev_comma[1:] = comma[:-1]
    field_start = is_start[:size] | prev_comma
    prev_quote = np.zeros(size, bool)
    prev_quote[1:] = quote[:-1]
    prev_quote &= ~is_start[:size]
    next_ok = np.ones(size, bool)
    if size:
        next_ok[:-1] = comma[1:] | quote[1:]
        next_ok[:-1] |= is_end[1:size]
    opening, closing = quote & ~odd, quote & odd
    bad = (opening & ~field_start & ~prev_quote) | (closing & ~next_ok)
    bad |= ((data == 10) | (data == 13)) & inside & ~odd
    broken = np.zeros(n, bool)
    broken[record[bad]] = True
    broken |= ((before[end] - before[start]) & 1).astype(bool)

    # what stays of each field: all but delimiters and the quotes that enclose; of a doubled quote the second
    doubled = opening & prev_quote & ~field_start
    keep = inside & ~comma & ~(quote & ~doubled)
    kept = np.zeros(size + 1, before.dtype)
    np.cumsum(keep, out=kept[1:])
    count = np.bincount(record[comma], minlength=n) + 1 if n else np.zeros(0, np.int64)
    first = np.zeros(n + 1, np.int64)
    np.cumsum(count, out=first[1:])
    begins = np.empty(first[-1] + 1, np.int64)
    begins[-1] = kept[size]
    heads = np.ones(first[-1], bool)
    heads[first[:-1]] = False
    begins[first[:-1]] = kept[start]
    begins[:-1][heads] = kept[np.flatnonzero(comma) + 1]
    values = pa.LargeStringArray.from_buffers(int(first[-1]), pa.py_buffer(begins.tobytes()), pa.py_buffer(data[keep].tobytes()))
    return Structure(values, first, broken)


# The digits of the largest and of the smallest whole number of 64 bits.
LARGEST, SMALLEST = "9223372036854775807", "9223372036854775808"


def _fits_64_bits(texts: pa.Array) -> np.ndarray:
    """Of texts that match WHOLE: whether the number fits, told by its digits, however many there are."""
    digits = pc.utf8_ltrim(pc.utf8_ltrim(texts, "-"), "0")
    size = pc.binary_length(digits)
    most = pc.if_else(pc.starts_with(texts, "-"), SMALLEST, LARGEST).cast(digits.type)
    fits = pc.or_(pc.less(size, len(LARGEST)), pc.and_(pc.equal(size, len(LARGEST)), pc.less_equal(digits, most)))
    return fits.to_numpy(zero_copy_only=False)


def _real_moment(texts: pa.Array) -> np.ndarray:
    """Of texts that match MOMENT: whether day and time exist, in years 1 to 9999."""
    if not len(texts):
        return np.zeros(0, bool)
    part = lambda a, b: pc.cast(pc.utf8_slice_codeunits(texts, a, b), pa.int64()).to_numpy(zero_copy_only=False)
    year, month, day, hour, minute, second = (part(a, b) for a, b in ((0, 4), (5, 7), (8, 10), (11, 13), (14, 16), (17, 19)))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(month, 0, 12)] + ((month == 2) & leap)
    return (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= days) & (hour < 24) & (minute < 60) & (second < 60)


def has_form(texts: pa.Array, form: str) -> np.ndarray:
    """Which of the non-empty ``texts`` are of ``form``."""
    match = lambda pattern: pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
    ok = ~match(FORBIDDEN)
    if form == "whole":
        ok &= match(WHOLE)
        ok[ok] = _fits_64_bits(texts.filter(pa.array(ok)))
    elif form == "moment":
        ok &= match(MOMENT)
        ok[ok] = _real_moment(texts.filter(pa.array(ok)))
    elif form in (patterns := {"number": NUMBER, "version": VERSION, "channel": CHANNEL}):
        ok &= match(patterns[form])
    elif form != "text":
        raise ValueError(f"unknown form {form!r}")
    # in RE2 `$` without flags is the end of the text only
    return ok


def check_batch(kinds: pa.Array, records: pa.Array, layout: Layout) -> tuple[np.ndarray, Structure]:
    """The reason of each record ('' if valid) and the batch's structure."""
    s = structural_index(records)
    count = np.diff(s.first)
    reason = np.full(len(records), "", dtype=object)
    reason[~s.broken] = "columns"
    kind = np.asarray(kinds.to_pylist(), dtype=object)
    missing = records.is_null().to_numpy(zero_copy_only=False)
    for name, fields in layout.fields.items():
        rows = np.flatnonzero((kind == name) & ~s.broken & ~missing & (count == len(fields)))
        bad = np.zeros(len(rows), bool)
        for k, field in enumerate(fields):
            texts = s.values.take(pa.array(s.first[rows] + k))
            empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
            bad |= empty & (not field.may_be_blank)
            if field.form == "by_key":
                keys = s.values.take(pa.array(s.first[rows])).to_pylist()
                forms = np.array([layout.key_forms.get(x, "text") for x in keys], dtype=object)
            else:
                forms = np.full(len(rows), field.form, dtype=object)
            for form in set(forms.tolist()):
                at = np.flatnonzero(~empty & (forms == form))
                if len(at):
                    bad[at[~has_form(texts.take(pa.array(at)), form)]] = True
        reason[rows] = np.where(bad, "value", "")
    reason[s.broken] = "quoting"
    return reason, s


def read_layout(raw_field: DataFrame, key_form: DataFrame) -> Layout:
    """The layout from its two tables, whose size is fixed by the file formats and not by the data."""
    fields: dict[str, list] = {}
    for r in sorted(raw_field.select("file_kind", "field_no", "field_name", "value_form", "may_be_blank").collect(), key=lambda r: r["field_no"]):
        fields.setdefault(r["file_kind"], []).append(Field(r["field_name"], r["value_form"], bool(r["may_be_blank"])))
    forms = {r["key_name"]: r["value_form"] for r in key_form.select("key_name", "value_form").collect()}
    return Layout({k: tuple(v) for k, v in fields.items()}, forms)


def split_rows(raw: DataFrame, layout: Layout) -> DataFrame:
    """Each record as (raw_id, file_kind, reason, fields): valid rows have a null reason and their fields.

    One narrow pass: no shuffle, any record goes through whichever task reads it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096):
                ids, kinds, records = (part.column(i) for i in range(3))
                reason, s = check_batch(kinds, records, layout)
                valid = reason == ""
                lists = pa.ListArray.from_arrays(pa.array(s.first.astype(np.int32)), s.values.cast(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [ids, kinds, pa.array([r or None for r in reason], pa.string()), pc.if_else(pa.array(valid), lists, pa.scalar(None, lists.type))],
                    names=["raw_id", "file_kind", "reason", "fields"],
                )

    return raw.select("raw_id", "file_kind", "raw").mapInArrow(run, "raw_id bigint, file_kind string, reason string, fields array<string>")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason").isNotNull()).select("raw_id", "reason")


def loaded(rows: DataFrame, layout: Layout, kind: str) -> DataFrame:
    """The valid rows of a file kind as a typed table; empty fields are null."""
    types = {"whole": "bigint", "number": "double", "moment": "timestamp_ntz"}
    columns = []
    for i, f in enumerate(layout.fields[kind]):
        value = F.nullif(F.get("fields", F.lit(i)), F.lit(""))
        columns.append((value.try_cast(types[f.form]) if f.form in types else value).alias(f.name))
    return rows.where(F.col("reason").isNull() & (F.col("file_kind") == kind)).select("raw_id", *columns)
