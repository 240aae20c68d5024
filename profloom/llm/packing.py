"""Filling fixed-capacity containers with items of whole-number sizes.

The instance is the histogram of the sizes: at most ``capacity`` classes, however many items there
are. On it the reduction of Martello and Toth fixes sets that dominate every other set with
the same item: an item that nothing fits beside goes alone; an item whose exact complement exists is
joined with it; where at most one more item fits, the largest that fits dominates; where at most two
fit, the largest pair does if no other pair has a larger smaller item. What remains is
filled best-fit, largest first, whole classes at a time. Then every item learns its container
from its rank within its class, in one narrow pass.

Defined cases: items longer than a container are cut into full containers and one rest; items of size
0 (null and empty texts) are spread evenly over the containers, all in container 0 if there is no
other; ties are ordered by key and piece; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profloom.llm.bpe import VOCABULARY, count_tokens
from profloom.runtime import cut_lineage, global_sequence

CAPACITY = 2048

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((size, how many), …), number of containers filled so


class Stock:
    """Items left by size."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = {s: c for s, c in counts.items() if s > 0 and c > 0}
        self.sizes = sorted(self.left)

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def largest(self, most: int, without: int | None = None) -> int | None:
        """The largest size of at most ``most``, one item of size ``without`` being in use."""
        i = bisect_left(self.sizes, most + 1) - 1
        if i >= 0 and self.sizes[i] == without and self.left[without] < 2:
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def smallest(self, n: int, without: int) -> list[int]:
        """The ``n`` smallest items beside one of size ``without``, or fewer."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.left[s] - (s == without))
            if len(out) >= n:
                break
        return out


def _dominating(stock: Stock, size: int, capacity: int) -> tuple[int, ...] | None:
    """The items that dominate any other beside one of ``size``; None if none are known to.

    As items are used up the conditions only get easier to meet, so the set may be fixed as often as it is there.
    """
    rest = capacity - size
    best = stock.largest(rest, size)
    if best is None:
        return ()
    if best == rest:
        return (best,)
    low = stock.smallest(3, size)
    if sum(low[:2]) > rest or len(low) < 2:
        return (best,)
    if len(low) == 3 and sum(low) <= rest:
        return None
    # at most two fit: the pair of the largest item and the largest beside it, unless some pair has a larger smaller item
    have = lambda s: stock.left.get(s, 0) - (s == size)
    stock_two = [s for s in stock.sizes if s <= rest - best and have(s) - (s == best) > 0]
    if not stock_two:
        pair_best = max((a + b for i, a in enumerate(stock.sizes) if have(a) > 0 for b in stock.sizes[i:] if a + b <= rest and have(b) - (a == b) > 0), default=0)
        return (best,) if best >= pair_best else None
    second = stock_two[-1]
    usable = [s for s in stock.sizes if s <= rest and have(s) > 0]
    least_of_pair = max((a for i, a in enumerate(usable) if (have(a) > 1 and 2 * a <= rest) or (i + 1 < len(usable) and a + usable[i + 1] <= rest)), default=0)
    return (best, second) if least_of_pair <= second else None


def reduce_dominated(stock: Stock, capacity: int) -> list[Pattern]:
    """Fix dominating sets, largest items first, until no rule applies to any size."""
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for size in sorted(stock.sizes, reverse=True):
            while stock.left.get(size):
                beside = _dominating(stock, size, capacity)
                if beside is None:
                    break
                fill: dict[int, int] = {size: 1}
                for s in beside:
                    fill[s] = fill.get(s, 0) + 1
                n = min(stock.left[s] // m for s, m in fill.items())
                for s, m in fill.items():
                    stock.take(s, m * n)
                fixed.append((tuple(sorted(fill.items())), n))
                changed = True
    return fixed


def best_fit(stock: Stock, capacity: int) -> list[Pattern]:
    """Best fit, largest first, over whole classes: equal containers are one group and split when need be."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}  # by free space
    free: list[int] = []

    def put(space: int, fill: dict[int, int], n: int) -> None:
        if space not in groups:
            groups[space] = []
            insort(free, space)
        groups[space].append((fill, n))

    for size in sorted(stock.sizes, reverse=True):
        left = stock.left[size]
        while left:
            i = bisect_left(free, size)
            space = free[i] if i < len(free) else capacity
            fill, n = groups[space].pop() if i < len(free) else ({}, left)
            if i < len(free) and not groups[space]:
                del groups[space]
                free.pop(i)
            each = space // size
            if left >= each:
                used = min(n, left // each) if i < len(free) or fill else left // each
                put(space - each * size, fill | {size: each}, used)
                left -= used * each
            else:
                used = 1
                put(space - left * size, fill | {size: left}, 1)
                left = 0
            if fill and n > used:
                put(space, fill, n - used)
    return [(tuple(sorted(f.items())), n) for space in free for f, n in groups[space]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """How to fill containers with items of these sizes (0 excepted)."""
    stock = Stock(counts)
    return reduce_dominated(stock, capacity) + best_fit(stock, capacity)


def intervals(counts: dict[int, int], patterns: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Items numbered by size: from ``start`` on, every ``each`` of them go to the containers from ``first`` on."""
    start_of, at = {}, 0
    for s in sorted(counts):
        start_of[s] = at
        at += counts[s]
    rows, container = [], 0
    for fill, n in patterns:
        for size, each in fill:
            rows.append((start_of[size], container, each))
            start_of[size] += n * each
        container += n
    rows.sort()
    start, first, each = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    return start, first, each, container


def pack_items(items: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``container_id`` to items with a column ``n_tokens`` of at most ``capacity`` each."""
    counts = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    start, first, each, n_containers = intervals(counts, plan(counts, capacity))
    zeros = counts.get(0, 0)
    numbered = global_sequence(items, ["n_tokens", *order])
    names = items.columns
    shared = items.sparkSession.sparkContext.broadcast((start, first, each))  # bounded by the number of sizes, not of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, first, each = shared.value
        for batch in batches:
            seq = batch["seq"].to_numpy()
            if len(start):
                i = np.maximum(np.searchsorted(start, seq, "right") - 1, 0)
                container = np.where(seq < zeros, seq % max(n_containers, 1), first[i] + (seq - start[i]) // each[i])
            else:
                container = np.zeros(len(seq), np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(container)], names=[*names, "container_id"])

    return numbered.select(*names, "seq").mapInArrow(run, T.StructType([*items.schema.fields, T.StructField("container_id", T.LongType())]))


def cut_long(sizes: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, n_tokens) → (key, piece_no, token_start, n_tokens): pieces of at most ``capacity`` tokens."""
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("bigint")
    start = F.col("piece_no") * capacity
    return (
        sizes.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)))
        .select(key, "piece_no", start.alias("token_start"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - start).alias("n_tokens"))
    )


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece_no, token_start, n_tokens, container_id) of every document."""
    items = cut_lineage(cut_long(count_tokens(documents, vocabulary=vocabulary), "doc_id", capacity))
    return pack_items(items, ["doc_id", "piece_no"], capacity)


def container_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per container: how many items and tokens it holds and what stays free."""
    return packed.groupBy("container_id").agg(
        F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"), (F.lit(capacity) - F.sum("n_tokens")).alias("n_free")
    )
