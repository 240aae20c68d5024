from datetime import datetime

import pytest

from profloom.operators import orphans

T = lambda d, m=1: datetime(2024, m, d)
IMAGE = "TableNumber bigint, ImageNumber bigint, loaded_at timestamp_ntz, removed_at timestamp_ntz"
NUCLEI = "TableNumber bigint, ImageNumber bigint, ObjectNumber bigint, loaded_at timestamp_ntz, removed_at timestamp_ntz"
PH3 = "TableNumber bigint, ImageNumber bigint, ObjectNumber bigint, Parent_Nuclei bigint, loaded_at timestamp_ntz"


def frames(spark, image=(), nuclei=(), ph3=()):
    return tuple(spark.createDataFrame(list(r), s) for r, s in ((image, IMAGE), (nuclei, NUCLEI), (ph3, PH3)))


def test_states(spark, rows):
    image = [(1, 1, T(1), None), (1, 2, T(1), T(5)), (1, 3, T(9), None), (1, 3, T(2), T(3))]
    nuclei = [(1, 1, 1, T(2), None), (1, 2, 1, T(2), None), (1, 3, 1, T(4, 2), None), (1, 3, 2, T(4), None), (1, 9, 1, T(4), None), (1, 9, 2, T(4), T(5))]
    ph3 = [(1, 1, 1, 1, T(1)), (1, 1, 2, 0, T(1)), (1, 1, 3, None, T(1)), (1, 9, 4, 2, T(6)), (1, 1, 5, 7, T(6))]
    got = rows(orphans.profile_orphans(*frames(spark, image, nuclei, ph3)))
    assert got == sorted([
        ("nuclei", "image", 1, 2, 1, "removed", "2024-01"),
        ("nuclei", "image", 1, 3, 2, "late", "2024-01"),
        ("nuclei", "image", 1, 9, 1, "missing", "2024-01"),
        ("ph3", "image", 1, 9, 4, "missing", "2024-01"),
        ("ph3", "nuclei", 1, 1, 1, "late", "2024-01"),
        ("ph3", "nuclei", 1, 9, 4, "removed", "2024-01"),
        ("ph3", "nuclei", 1, 1, 5, "missing", "2024-01"),
    ], key=repr)


def test_a_child_counts_once_by_its_earliest_row(spark, rows):
    ph3 = [(1, 1, 1, 5, T(9)), (1, 1, 1, 6, T(3)), (1, 1, 1, 6, T(3)), (1, 1, 1, 7, None)]
    got = rows(orphans.profile_orphans(*frames(spark, [(1, 1, T(1), None)], [(1, 1, 6, T(1), None)], ph3)))
    assert got == []


def test_empty_tables(spark, rows):
    assert rows(orphans.profile_orphans(*frames(spark))) == []
    got = rows(orphans.profile_orphans(*frames(spark, ph3=[(1, 1, 1, 2, T(1))])), "parent_name", "state")
    assert got == [("image", "missing"), ("nuclei", "missing")]


def test_null_load_times(spark, rows):
    image = [(1, 1, None, None)]
    ph3 = [(1, 1, 1, 4, None)]
    assert rows(orphans.profile_orphans(*frames(spark, image, [], ph3))) == [("ph3", "nuclei", 1, 1, 1, "missing", None)]


def test_clashing_columns_do_no_harm(spark, rows):
    from pyspark.sql import functions as F

    image, nuclei, ph3 = frames(spark, [(1, 1, T(1), None)], [(1, 1, 1, T(2), None)], [(1, 1, 1, 9, T(3))])
    extra = {c: F.lit("x") for c in ("state", "is_live", "live_from", "__mask", "t", "i", "o", "ref", "child_name")}
    got = rows(orphans.profile_orphans(*(df.withColumns(extra) for df in (image, nuclei, ph3))))
    assert got == [("ph3", "nuclei", 1, 1, 1, "missing", "2024-01")]


@pytest.mark.parametrize(("match", "expected"), [("simple", [3]), ("partial", [3, 5, 6]), ("full", [2, 3, 5, 6])])
def test_match_semantics(spark, rows, match, expected):
    parents = orphans.parent_states(spark.createDataFrame([(1, 10, T(1)), (2, 20, T(1))], "a bigint, b bigint, at timestamp_ntz"), ["a", "b"], "at")
    children = spark.createDataFrame(
        [(1, 1, 10, T(2)), (2, 1, None, T(2)), (3, 1, 20, T(2)), (4, None, None, T(2)), (5, None, 30, T(2)), (6, 7, None, T(2))], "id bigint, x bigint, y bigint, seen timestamp_ntz"
    )
    got = rows(orphans.find_orphans(children, parents, [("x", "a"), ("y", "b")], "seen", match), "id")
    assert [r[0] for r in got] == expected


def test_unknown_semantics(spark):
    with pytest.raises(ValueError, match="match"):
        orphans.find_orphans(None, None, [], "t", "loose")


def test_report(spark, rows):
    df = spark.createDataFrame([("a", "b", "missing", "2024-01")] * 2 + [("a", "b", "late", None)], "child_name string, parent_name string, state string, period string")
    assert rows(orphans.orphan_report(df)) == [("a", "b", "late", None, 1), ("a", "b", "missing", "2024-01", 2)]
