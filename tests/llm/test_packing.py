import random

import pytest
from pyspark.sql import functions as F

from profloom.llm import bpe, packing


def least(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, free):
        if len(free) >= best[0]:
            return
        if i == len(items):
            best[0] = len(free)
            return
        for f in set(free):
            if f >= items[i]:
                k = free.index(f)
                free[k] -= items[i]
                go(i + 1, free)
                free[k] += items[i]
        go(i + 1, [*free, capacity - items[i]])

    go(0, [])
    return best[0]


def check(counts, capacity):
    patterns, used = packing.plan(counts, capacity), {}
    for fill, n in patterns:
        assert n > 0 and sum(s * m for s, m in fill) <= capacity
        for s, m in fill:
            used[s] = used.get(s, 0) + m * n
    assert used == {s: c for s, c in counts.items() if s > 0 and c > 0}
    return sum(n for _, n in patterns), len(patterns)


def test_reduction_never_costs_a_container():
    random.seed(1)
    for _ in range(1500):
        capacity = random.choice([7, 12, 20, 50])
        items = [random.randint(1, capacity) for _ in range(random.randint(0, 8))]
        counts = {}
        for x in items:
            counts[x] = counts.get(x, 0) + 1
        stock = packing.Stock(counts)
        fixed = packing.reduce_dominated(stock, capacity)
        left = [s for s, c in stock.left.items() for _ in range(c)]
        assert sum(n for _, n in fixed) + least(left, capacity) == least(items, capacity), items
        assert check(counts, capacity)[0] <= least(items, capacity) + 1


def test_large_histograms():
    random.seed(2)
    for counts in ({s: random.randint(0, 10**9) for s in range(1, 2049)}, {1500: 10**12, 600: 3 * 10**12, 3: 5}, {2048: 7}, {1: 10**9}, {1025: 11, 1024: 5}, {0: 9}, {}):
        n, patterns = check(counts, 2048)
        total = sum(s * c for s, c in counts.items())
        assert n >= -(-total // 2048) and patterns < 50_000
        if len(counts) > 2000:
            assert n <= 1.01 * total / 2048


def packed(spark, sizes, capacity=10):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id bigint, n_tokens bigint")
    items = packing.cut_long(df, "doc_id", capacity)
    return packing.pack_items(items, ["doc_id", "piece_no"], capacity).collect()


@pytest.mark.parametrize("sizes", [[], [0], [0, 0, 0], [10], [25, 3, 0], [9] * 500 + [1] * 400 + [5] * 7, [31, 30, 29, 0, 10, 11], list(range(60))])
def test_items(spark, sizes):
    rows, containers, pieces = packed(spark, sizes), {}, {}
    for r in rows:
        containers[r["container_id"]] = containers.get(r["container_id"], 0) + r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["piece_no"], r["token_start"], r["n_tokens"]))
    assert all(n <= 10 for n in containers.values()) and sorted(containers) == list(range(len(containers)))
    for i, n in enumerate(sizes):
        own = sorted(pieces[i])
        assert len(own) == max(1, -(-n // 10)) and sum(x[2] for x in own) == n
        assert [x[1] for x in own] == [10 * k for k in range(len(own))]


def test_documents(spark, documents):
    extra = documents.withColumns({c: F.lit(1) for c in ("container_id", "n_tokens", "seq", "piece_no")})
    rows = packing.pack_documents(extra)
    sizes = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(documents).collect()}
    got = {r["doc_id"]: r["n"] for r in rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got == sizes
    report = packing.container_report(rows).collect()
    total = sum(sizes.values())
    assert all(0 <= r["n_free"] < packing.CAPACITY or r["n_tokens"] == 0 for r in report)
    assert len(report) <= -(-total // packing.CAPACITY) + max(2, 0.02 * len(report))
    assert packing.pack_documents(documents.limit(0)).collect() == []


def test_sizes_of_slices_that_agree_in_sums(spark, vocabulary):
    """Sizes don't depend on which texts share a worker, even where sums of letters over powers agree."""
    from profloom.llm.bpe import ByteBPE, count_tokens

    word = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    texts = [word, word.translate(str.maketrans("ab", "ba"))] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    sizes = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df).collect()}
    assert sizes == {i: len(ByteBPE(vocabulary).encode(t)) for i, t in enumerate(texts)}
