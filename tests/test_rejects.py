import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest

from profloom.operators import rejects
from profloom.operators.rejects import Field, Layout

LAYOUT = Layout({"experiment": (Field("Key", "text", False), Field("Value", "by_key", True)), "image": (Field("ImageNumber", "whole", False), Field("When", "moment", True), Field("Count", "number", True))}, {"V": "version", "C": "channel", "N": "whole"})


def walk(raw):
    """Fields of a record by reading it sign by sign; None if its quoting is broken."""
    if raw.endswith("\r"):
        raw = raw[:-1]
    fields, i = [], 0
    while True:
        if i < len(raw) and raw[i] == '"':
            i += 1
            text = ""
            while True:
                if i >= len(raw):
                    return None
                if raw[i] == '"':
                    if raw[i + 1 : i + 2] == '"':
                        text += '"'
                        i += 2
                        continue
                    i += 1
                    break
                text += raw[i]
                i += 1
            if i < len(raw) and raw[i] != ",":
                return None
        else:
            text = ""
            while i < len(raw) and raw[i] != ",":
                if raw[i] in '"\r\n':
                    return None
                text += raw[i]
                i += 1
        fields.append(text)
        if i >= len(raw):
            return fields
        i += 1


def check(records, kinds=None):
    kinds = kinds or ["experiment"] * len(records)
    return rejects.check_batch(pa.array(kinds, pa.string()), pa.array(records, pa.string()), LAYOUT)


def test_structure_equals_a_reader_sign_by_sign():
    random.seed(7)
    records = ["".join(random.choice('a",\r\né"') for _ in range(random.randint(0, 9))) for _ in range(20_000)]
    for array in (pa.array(records), pa.array(["xx", *records]).slice(1)):
        s = rejects.structural_index(array)
        values = s.values.to_pylist()
        for i, r in enumerate(records):
            expected = walk(r)
            assert s.broken[i] == (expected is None), repr(r)
            if expected is not None:
                assert values[s.first[i] : s.first[i + 1]] == expected, repr(r)


def test_reasons_in_order():
    reason, _ = check(['a,"b', "a", "a,b,c", ",x", "a,", "V,1.2", "V,1", "C,color", 'a,"x\ny"', "a,\x01", "a,�", "a,\t", "N,007", "N,9223372036854775808", "N,-9223372036854775808", "", None])
    assert reason.tolist() == ["quoting", "columns", "columns", "value", "", "", "value", "value", "", "value", "value", "", "", "value", "", "columns", "columns"]


def test_unknown_kinds_are_rejected():
    assert check(["a,b", 'a,"'], ["other", None])[0].tolist() == ["columns", "quoting"]


@pytest.mark.parametrize(("form", "text", "ok"), [
    ("number", "1", True), ("number", "-1.5e-3", True), ("number", "nAn", True), ("number", "+1", False), ("number", "1e", False), ("number", "inf", False), ("number", "1.2.3", False), ("number", "٣", False),
    ("whole", "-0", True), ("whole", "1.0", False), ("whole", " 1", False), ("whole", "1\n", False), ("version", "1.2.3.4", True), ("version", "1.2.3.4.5", False), ("channel", "Color", True),
    ("moment", "2024-02-29T23:59:59", True), ("moment", "2023-02-29T00:00:00", False), ("moment", "1900-02-29T00:00:00", False), ("moment", "0000-01-01T00:00:00", False), ("moment", "2024-01-01T24:00:00", False),
    ("moment", "2024-13-01T00:00:00", False), ("moment", "2024-1-01T00:00:00", False), ("text", "x\x7f", False), ("text", "\r\n\t", True),
])
def test_forms(form, text, ok):
    assert rejects.has_form(pa.array([text]), form).tolist() == [ok]


def test_unknown_form():
    with pytest.raises(ValueError, match="form"):
        rejects.has_form(pa.array(["a"]), "odd")


def test_split_and_load(spark, rows):
    raw = spark.createDataFrame([(1, "image", '5,2024-01-01T00:00:00,"1.5"\r', "x"), (2, "image", "x,,", "x"), (3, "image", "6,,", "x"), (None, None, None, "x")], "raw_id bigint, file_kind string, raw string, reason string")
    split = rejects.split_rows(raw, LAYOUT)
    assert rows(rejects.rejected(split)) == [(2, "value"), (None, "columns")]
    assert rows(rejects.loaded(split, LAYOUT, "image")) == [(1, 5, datetime(2024, 1, 1), 1.5), (3, 6, None, None)]
    empty = rejects.split_rows(raw.limit(0), LAYOUT)
    assert empty.count() == 0


def test_very_long_record():
    text = "x" * 3_000_000
    _, s = check([f'k,"{text}""{text}"', "k,v"])
    assert s.values[1].as_py() == f'{text}"{text}' and np.array_equal(s.broken, [False, False])


def test_whole_table_against_a_reader(spark, data):
    raw = spark.read.parquet(f"{data}/raw_row.parquet")
    layout = rejects.read_layout(spark.read.parquet(f"{data}/raw_field.parquet"), spark.read.parquet(f"{data}/experiment_key.parquet"))
    got = {r["raw_id"]: r["reason"] for r in rejects.rejected(rejects.split_rows(raw, layout)).collect()}
    for r in raw.collect():
        fields = walk(r["raw"])
        expected = "quoting" if fields is None else "columns" if len(fields) != len(layout.fields[r["file_kind"]]) else None
        if expected is not None:
            assert got[r["raw_id"]] == expected
        else:
            assert got.get(r["raw_id"]) in (None, "value")


@pytest.mark.parametrize("digits", [19, 20, 400, 5000, 100_000])
def test_whole_numbers_of_any_length(digits):
    texts = ["1" * digits, "-" + "9" * digits, "0" * digits, "-" + "0" * digits + "7", "0" * digits + "9223372036854775807", "0" * digits + "9223372036854775808", "-" + "0" * digits + "9223372036854775808"]
    assert rejects.has_form(pa.array(texts), "whole").tolist() == [digits == 19, False, True, True, True, False, True]
    reason, _ = check(["N," + t for t in texts])
    assert reason.tolist() == ["" if ok else "value" for ok in (digits == 19, False, True, True, True, False, True)]


def test_whole_numbers_near_the_limits():
    texts = [f"{sign}{x + d}" for sign in ("", "-") for x in (1 << 63, 10**18, 10**19) for d in range(-2, 3)]
    assert rejects.has_form(pa.array(texts), "whole").tolist() == [-(1 << 63) <= int(t) < 1 << 63 for t in texts]
