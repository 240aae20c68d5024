import pyarrow as pa
import pytest

from profloom import runtime


def test_slices_bound_rows_and_bytes():
    batch = pa.RecordBatch.from_pydict({"x": ["a" * n for n in (5, 100_000, 7, 0, 90_000, 3, 3, 3)], "y": list(range(8))})
    parts = list(runtime.slices(batch, 3, 50_000))
    assert [y for p in parts for y in p["y"].to_pylist()] == list(range(8)) and all(p.num_rows <= 3 for p in parts)
    assert all(p.nbytes <= 50_000 or p.num_rows == 1 for p in parts)
    assert list(runtime.slices(batch.slice(0, 0), 3)) == []


@pytest.mark.parametrize("n", [0, 1, 500])
def test_numbers_follow_the_order(spark, n):
    df = spark.createDataFrame([((i * 37) % 101 if i % 7 else None, i, "x") for i in range(n)], "a int, b int, seq2 string")
    got = [(r["a"], r["b"]) for r in sorted(runtime.global_sequence(df, ["a", "b"]).collect(), key=lambda r: r["seq"])]
    assert got == sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(r["seq"] for r in runtime.global_sequence(df, ["a", "b"]).collect()) == list(range(n))


def test_written_tables_keep_their_schema(spark):
    df = spark.range(5).selectExpr("id", "array(id) AS a", "cast(null AS string) AS s")
    back = runtime.materialize(df, "test")
    assert back.schema.simpleString() == df.schema.simpleString() and back.count() == 5
    assert runtime.cut_lineage(df).count() == 5 and runtime.shared_dir(spark)


def test_the_package_is_shipped_once(spark, monkeypatch, tmp_path):
    shipped = []
    monkeypatch.setattr(spark.sparkContext, "addPyFile", shipped.append)
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("PYTHONPATH", "")
    runtime.ship_package(spark)
    runtime.ship_package(spark)
    assert len(shipped) == 1 and shipped[0].endswith(".zip")
