import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from profloom.llm import quantiles as q


def exact(values, p):
    return sorted(values)[max(1, math.ceil(p * len(values) / 100)) - 1]


def rank_error(values, found, p):
    v = np.sort(np.asarray(values))
    rank = max(1, math.ceil(p * len(v) / 100))
    low, high = np.searchsorted(v, found, "left") + 1, np.searchsorted(v, found, "right")
    return max(low - rank, rank - high, 0)


def table(spark, groups, partitions=7):
    rows = [(g, float(x)) for g, values in groups.items() for x in values]
    return spark.createDataFrame(rows, "g string, x double").repartition(partitions)


def run(df, percents, eps=q.EPSILON, block_rows=q.BLOCK_ROWS, keys=("g",)):
    keys = list(keys)
    s = q.merge_summaries(q.summarize(df, keys, "x", eps, block_rows), keys, eps)
    return {r["g"]: r for r in q.percentiles(s, keys, percents).collect()}


@pytest.mark.parametrize("block_rows", [50, 500_000])
@pytest.mark.parametrize("eps", [0.004, 0.05])
def test_error_is_bounded_and_known(spark, block_rows, eps):
    rng = np.random.default_rng(1)
    groups = {
        "hot": rng.normal(size=6000), "ties": rng.integers(0, 4, 3000).astype(float), "same": np.full(2000, 7.0), "skew": rng.pareto(1, 2500), "rising": np.arange(2000.0), "few": rng.normal(size=9), "one": np.array([3.0]),
    }
    got = run(table(spark, groups), [1, 10, 50, 90, 99, 100], eps, block_rows)
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["n"] == len(values)
        assert got[g]["gap"] / 2 <= max(1, eps * len(values) + 1)
        for p in (1, 10, 50, 90, 99, 100):
            assert got[g][f"p{p}"] in values
            assert rank_error(values, got[g][f"p{p}"], p) <= max(0, got[g]["gap"] / 2), (g, p)
        if len(values) < 1 / eps:
            assert [got[g][f"p{p}"] for p in (10, 50, 90)] == [exact(values, p) for p in (10, 50, 90)]


def test_days_can_be_combined(spark):
    rng = np.random.default_rng(2)
    days = [{"a": rng.normal(d, 1, 1500), "b": rng.normal(size=200)} for d in range(4)]
    summaries = [q.merge_summaries(q.summarize(table(spark, d, 3), ["g"], "x"), ["g"]) for d in days]
    both = summaries[0]
    for s in summaries[1:]:
        both = both.unionByName(s)
    got = {r["g"]: r for r in q.percentiles(q.merge_summaries(both, ["g"]), ["g"], [50, 95]).collect()}
    for g in "ab":
        values = np.concatenate([d[g] for d in days])
        assert got[g]["n"] == len(values)
        assert all(rank_error(values, got[g][f"p{p}"], p) <= got[g]["gap"] / 2 <= 0.02 * len(values) for p in (50, 95))


def test_values_that_do_not_count(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("a", float("inf")), ("a", -1.0), ("b", None), (None, 5.0), (None, 6.0)], "g string, x double")
    got = run(df, [50, 100])
    assert set(got) == {"a", None} and got["a"]["p50"] == -1.0 and got["a"]["p100"] == float("inf") and got[None]["n"] == 2
    assert run(df.limit(0), [50]) == {}


def test_clashing_columns(spark):
    df = table(spark, {"a": [1, 2, 3]}).withColumns({c: F.lit(0) for c in ("n", "lane", "value", "rmin", "gap", "__value")})
    assert run(df, [50])["a"]["p50"] == 2.0


def test_merge_of_exact_summaries_is_exact():
    rng = np.random.default_rng(3)
    group, summary, value, rmin, n = [], [], [], [], []
    for s in range(40):
        g = s % 3
        v = np.sort(rng.integers(0, 20, rng.integers(1, 30)))
        group += [g] * len(v)
        summary += [s] * len(v)
        value += v.tolist()
        rmin += range(1, len(v) + 1)
        n += [len(v)] * len(v)
    a = [np.array(x) for x in (group, summary, value, rmin, rmin, n)]
    g, v, low, high, total = q.merge(*a)
    for k in range(3):
        at = g == k
        assert (low[at] == high[at]).all() and low[at].tolist() == list(range(1, at.sum() + 1)) and (np.diff(v[at]) >= 0).all() and (total[at] == at.sum()).all()


def test_wells(spark):
    ph3 = spark.createDataFrame([(1, 1, 1, 5.0), (1, 1, 1, 5.0), (1, 1, 2, 9.0), (1, 1, 3, None), (1, 1, 4, float("nan")), (1, 2, 1, 1.0), (9, 9, 9, 1.0), (None, 1, 1, 2.0)], "TableNumber bigint, ImageNumber bigint, ObjectNumber bigint, Location_Center_X double")
    image = spark.createDataFrame([(1, 1, "P", "A"), (1, 1, "P", "A"), (1, 2, "P", None), (None, 1, "P", "A")], "TableNumber bigint, ImageNumber bigint, Metadata_Plate string, Metadata_Well string")
    got = q.well_percentiles(ph3, image, [50, 90]).collect()
    assert [(*tuple(r)[:3], r["p50"], r["p90"]) for r in got] == [("P", "A", 2, 5.0, 9.0)]
    assert q.well_percentiles(ph3.limit(0), image, [50]).collect() == []


def test_found_equals_sql(spark, data):
    import duckdb

    from profloom.llm.queries import QUERIES, SQL

    db = duckdb.connect()
    for t in ("ph3", "image"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    expected = sorted(db.execute(SQL["p3_found"]).fetchall())
    assert sorted(map(tuple, QUERIES["p3_found"](spark, data).collect())) == expected


@pytest.mark.parametrize("eps", [0.004, 0.05])
def test_summaries_of_days_are_merged(spark, eps):
    """Summaries stored by day give, once merged, percentiles within the bound that they tell."""
    rng = np.random.default_rng(8)
    values = [(int(g), f"2024-01-{d:02d}", float(v)) for g, d, v in zip(rng.integers(0, 2, 20_000), rng.integers(1, 29, 20_000), rng.normal(size=20_000))]
    df = spark.createDataFrame(values, "g int, day string, v double")
    by_day = q.merge_summaries(q.summarize(df, ["g", "day"], "v", eps), ["g", "day"], eps)
    assert by_day.count() == 56
    for r in q.percentiles(q.merge_parts(by_day, "day", ["g"], eps), ["g"], [10, 50, 90]).collect():
        own = np.sort([v for g, _, v in values if g == r["g"]])
        assert r["n"] == len(own) and r["gap"] <= 4 * eps * len(own) + 2
        for p in (10, 50, 90):
            assert abs(np.searchsorted(own, r[f"p{p}"]) + 1 - np.ceil(p * len(own) / 100)) <= r["gap"] / 2 + 1
