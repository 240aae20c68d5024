"""Long exact spans shared between records.

A character is shared if it lies in a window of ``length`` characters that also stands, character for
character, in another record. The paragraphs compared are all these windows: each has as its MinHash
the least of the hashes of its ``gram``-character shingles, a single band of one row, so that equal
windows always collide. Consecutive windows with the same minimum at the same place form a *block*
(about half of ``length − gram`` windows); blocks with the same minimum collide, and

* blocks that are equal as a whole in two records are shared, every window of them;
* of the other colliding blocks the windows are compared one by one, from the records' text;

and the shared windows of a record are joined into its maximal stretches. Characters aren't compared one by
one: texts count as equal if two 64-bit hashes of unrelated bases agree, that of the least shingle and that of
the block or window. Both are polynomials modulo 2^64, for which there are words whose hashes agree in
some low bits whatever the base. Within the at most 300 characters of a block these words (of 128 and 256
letters) fix 34 and 43 bits of each hash, so that 30 and 21 bits a hash still tell even them apart; texts not built so
agree with probability 2^-128 a pair.

Scale. Blocks that occur in two records read by the same task are settled there and only one
representative goes on, so a disclaimer in a third of all records costs one row per task and block.
Minima that still collide more often than ``crowd`` times (at most 100 000 of them can, whatever the
input) are salted, and the windows they leave open are settled by an exchange of window hashes, of
which every task sends at most one per record and window. No task holds a crowd, no pairs are made.

Defined cases: null, empty and short texts share nothing; a text repeated within one record only is
not shared; equal records share all of their text if it is long enough; a null key is a record of its
own, distinct from every other key; rows of one key are one record with several texts, whose stretches
are reported together; the key is an integer; offsets are code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from profloom.runtime import materialize

LENGTH = 200
GRAM = 100
CHUNK = 1 << 19  # characters hashed at once
BLOCK_ROWS = 400_000  # blocks compared within a task before the exchange
CROWD = 20_000

_FIRST = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Hashes of any slices of an array of code points, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, base: int, salt: int) -> None:
        self.base, self.salt = base, np.uint64(salt)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def load(self, points: np.ndarray) -> None:
        if len(points) > len(self.powers):
            n = max(len(points), CHUNK + 2 * LENGTH)
            for name, x in (("powers", self.base), ("inverses", pow(self.base, -1, 1 << 64))):
                p = np.full(n, x, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        value = (points.astype(np.uint64) + np.uint64(1)) * self.salt
        value ^= value >> np.uint64(29)
        value *= self.powers[: len(points)]
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(value, out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.inverses[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverses[start])


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = h ^ (h >> np.uint64(shift))
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _hashers() -> tuple[Hasher, Hasher]:
    return Hasher(0xD1B54A32D192ED03, 0xC2B2AE3D27D4EB4F), Hasher(0xABC98388FB8FAC03, 0x165667B19E3779F9)


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if reach < width else x


def blocks(texts: list[str], grams: Hasher, spans: Hasher, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The blocks of some texts of at least ``length`` characters, at most 2^24 together.

    Returns text number, first window, number of windows, place of the minimum behind the first
    window's start, hash of the minimum, hash of the block.
    """
    points = _points(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    grams.load(points)
    spans.load(points)
    hashes = grams.all(gram)
    # of equal hashes in a window the leftmost counts: the low bits are the place
    place_bits = np.uint64((1 << 24) - 1)
    least = _least((hashes & ~place_bits) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    n_windows = sizes - length + 1
    window = np.repeat(begin - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(int(n_windows.sum()))
    at = (least[window] & place_bits).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(head, len(at)))
    first, at = window[head], at[head]
    text = np.searchsorted(begin, first, "right") - 1
    whole = spans.of(first, first + count - 1 + length) ^ _mixed((at - first).astype(np.uint64) + _FIRST)
    return text, first - begin[text], count, at - first, hashes[at], whole


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal values, and the run of each value."""
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


class Blocks:
    """Columns of blocks, as they go between tasks."""

    NAMES = ("least", "whole", "doc", "first", "count", "place", "many")
    SCHEMA = "kind int, least bigint, whole bigint, doc bigint, first bigint, count int, place int, many boolean, peers int"


def settle(least: np.ndarray, whole: np.ndarray, doc: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order blocks by minimum and class; of each (in that order) whether its class is in several records.

    ``many`` marks blocks known to be so. Returns order, run of the minimum, shared, first of its class.
    """
    order = np.lexsort((doc, whole, least))
    least, whole, doc, many = least[order], whole[order], doc[order], many[order]
    new_least = np.concatenate([[True], least[1:] != least[:-1]])
    new_class = new_least | np.concatenate([[True], whole[1:] != whole[:-1]])
    start = np.flatnonzero(new_class)
    size = np.diff(np.append(start, len(order)))
    several = (doc[start] != doc[start + size - 1]) | np.logical_or.reduceat(many, start)
    return order, np.cumsum(new_least) - 1, np.repeat(several, size), new_class


def _intervals_batch(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """Intervals of the same record that touch are joined, to send fewer."""
    if not len(doc):
        return {"doc": doc, "start": start, "end": end}
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # ends within a record, made comparable over records by a number of the record
    rank = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    reach = np.maximum.accumulate(end + rank * (1 << 40))
    new = np.concatenate([[True], (start + rank * (1 << 40))[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return {"doc": doc[at], "start": start[at], "end": np.maximum.reduceat(end, at)}


def _batch(columns: dict[str, object], names: list[str], n: int, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], types[c]) if c in columns else pa.nulls(n, types[c]) for c in names], names=names)


_FOUND = {"kind": pa.int32(), "least": pa.int64(), "whole": pa.int64(), "doc": pa.int64(), "first": pa.int64(), "count": pa.int32(), "place": pa.int32(), "many": pa.bool_(), "peers": pa.int32()}
INTERVAL, BLOCK, MARK = 0, 1, 2  # kinds: an interval has its start in first and its end in whole


def _found(kind: int, n: int, **columns: object) -> pa.RecordBatch:
    return _batch(columns | {"kind": np.full(n, kind)}, list(_FOUND), n, _FOUND)


def _interval_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    x = _intervals_batch(doc, start, end)
    return _found(INTERVAL, len(x["doc"]), doc=x["doc"], first=x["start"], whole=x["end"])


def find_blocks(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """All blocks of ``documents`` (doc, text), those settled within a task as intervals."""

    def settled(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, first, count, place, least, whole = (np.concatenate(x) for x in zip(*held))
        least, whole = least.view(np.int64), whole.view(np.int64)
        order, run, shared, new_class = settle(least, whole, doc, np.zeros(len(doc), bool))
        doc, first, count, place, least, whole = (x[order] for x in (doc, first, count, place, least, whole))
        yield _interval_rows(doc[shared], first[shared], first[shared] + count[shared] - 1 + length)
        keep = ~shared | new_class
        peers = np.bincount(run[keep], minlength=run[-1] + 1)[run]
        columns = {"least": least, "whole": whole, "doc": doc, "first": first, "count": count, "place": place, "many": shared, "peers": peers}
        for at in range(0, int(keep.sum()), 65_536):
            part = {c: x[keep][at : at + 65_536] for c, x in columns.items()}
            yield _found(BLOCK, len(part["doc"]), **part)
        yield _found(MARK, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, spans = _hashers()
        held: list[tuple[np.ndarray, ...]] = []
        rows, texts, docs, offsets, size = 0, [], [], [], 0

        def hashed() -> tuple[np.ndarray, ...]:
            text, first, count, place, least, whole = blocks(texts, grams, spans, length, gram)
            return np.array(docs, np.int64)[text], first + np.array(offsets, np.int64)[text], count, place, least, whole

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = value.as_py()
                # a text longer than a chunk is hashed in parts that share length − 1 characters
                for at in range(0, max(1, len(value) - length + 1), CHUNK):
                    part = value[at : at + CHUNK + length - 1] if len(value) > CHUNK else value
                    if len(part) < length:
                        continue
                    if texts and size + len(part) > CHUNK:
                        held.append(hashed())
                        rows += len(held[-1][0])
                        texts, docs, offsets, size = [], [], [], 0
                        if rows >= BLOCK_ROWS:
                            yield from settled(held)
                            held, rows = [], 0
                    texts.append(part)
                    docs.append(key)
                    offsets.append(at)
                    size += len(part)
                    if len(value) <= CHUNK:
                        break
        if texts:
            held.append(hashed())
        if held:
            yield from settled(held)

    return documents.where(F.length("text") >= length).select("doc", "text").mapInArrow(run, Blocks.SCHEMA)


def _by_run(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, weight: str | None = None) -> Iterator[pa.Table]:
    """Tables of whole runs of ``keys`` from sorted batches, of about ``rows`` rows (or characters of ``weight``) each."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            held.append(part)
            n += len(part) if weight is None else part.column(weight).nbytes
            if n < rows:
                continue
            table = pa.Table.from_batches(held)
            same = np.ones(len(table), bool)
            for k in keys:
                column = table[k].to_numpy()
                same &= column == column[-1]
            if not same.all():
                cut = int(np.flatnonzero(~same)[-1]) + 1
                yield table.slice(0, cut)
                held, n = table.slice(cut).to_batches(), 0
                n = sum(len(b) if weight is None else b.column(weight).nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


OPEN = "kind int, least bigint, salt int, hot boolean, doc bigint, first bigint, count int, place int, many boolean, end bigint"
_OPEN = {"kind": pa.int32(), "least": pa.int64(), "salt": pa.int32(), "hot": pa.bool_(), "doc": pa.int64(), "first": pa.int64(), "count": pa.int32(), "place": pa.int32(), "many": pa.bool_(), "end": pa.int64()}


def settle_blocks(found: DataFrame, length: int) -> DataFrame:
    """Compare all blocks of the same minimum (and salt): intervals, and the blocks left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_run(batches, ["least", "salt"], 200_000):
            c = {n: table[n].to_numpy() for n in ("least", "salt", "hot", "whole", "doc", "first", "count", "place", "many")}
            group = c["least"].astype(np.int64) ^ (c["salt"].astype(np.int64) * np.int64(0x5851F42D4C957F2D))
            order, g, shared, new_class = settle(group, c["whole"], c["doc"], c["many"])
            c = {n: x[order] for n, x in c.items()}
            tell = shared & ~c["many"]
            x = _intervals_batch(c["doc"][tell], c["first"][tell], (c["first"] + c["count"] - 1 + length)[tell])
            yield _batch({"kind": np.full(len(x["doc"]), INTERVAL), "doc": x["doc"], "first": x["start"], "end": x["end"]}, list(_OPEN), len(x["doc"]), _OPEN)
            # open: classes of one record where others collide, and one block of each other class beside them
            starts, _ = _runs(g)
            lone = np.logical_or.reduceat(~shared, starts)[g]
            classes = np.add.reduceat(new_class.astype(np.int64), starts)[g]
            records = (np.minimum.reduceat(c["doc"], starts) != np.maximum.reduceat(c["doc"], starts))[g]
            collide = (classes > 1) & lone & (records | np.logical_or.reduceat(shared, starts)[g])
            still = (collide | c["hot"]) & (~shared | new_class)
            n = int(still.sum())
            columns = {k: c[k][still] for k in ("least", "salt", "hot", "doc", "first", "count", "place")}
            yield _batch(columns | {"kind": np.full(n, BLOCK), "many": shared[still]}, list(_OPEN), n, _OPEN)

    return (
        found.repartition("least", "salt").sortWithinPartitions("least", "salt")
        .select("least", "salt", "hot", "whole", "doc", "first", "count", "place", "many").mapInArrow(run, OPEN)
    )


WINDOWS = "kind int, doc bigint, start bigint, end bigint, window bigint, many boolean"
_WINDOWS = {"kind": pa.int32(), "doc": pa.int64(), "start": pa.int64(), "end": pa.int64(), "window": pa.int64(), "many": pa.bool_()}
WINDOW_ROW = 3


def settle_windows(spans: DataFrame, length: int) -> DataFrame:
    """Compare the windows of open blocks of the same minimum (and salt).

    Gives intervals, and of hot minima the windows that other salts may still share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hasher = _hashers()
        for table in _by_run(batches, ["least", "salt"], 4 << 20, "span"):
            count = table["count"].to_numpy().astype(np.int64)
            texts = table["span"].to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            hasher.load(_points(texts))
            begin = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(count)), count)
            j = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            start = begin[row] + j
            least = table["least"].to_numpy().view(np.uint64)
            window = hasher.of(start, start + length) ^ _mixed(least + _FIRST)[row]
            doc, many, hot = (table[c].to_numpy() for c in ("doc", "many", "hot"))
            # groups of one minimum with different salts are compared too; that can only settle more
            code, distinct = pd.factorize(window)
            any_doc = np.zeros(len(distinct), np.int64)
            any_doc[code] = doc[row]
            several = np.bincount(code, (any_doc[code] != doc[row]) | many[row], len(distinct)) > 0
            shared = several[code]
            tell = shared & ~many[row]
            place = table["first"].to_numpy()[row] + j
            x = _intervals_batch(doc[row][tell], place[tell], place[tell] + length)
            yield _batch({"kind": np.full(len(x["doc"]), INTERVAL), **x}, list(_WINDOWS), len(x["doc"]), _WINDOWS)
            if hot.any():
                once = np.zeros(len(code), bool)
                once[np.unique(code, return_index=True)[1]] = True
                send = hot[row] & (~shared | once)
                for at in np.array_split(np.flatnonzero(send), max(1, int(send.sum()) // 65_536)):
                    columns = {"doc": doc[row][at], "start": place[at], "end": place[at] + length, "window": window[at].view(np.int64), "many": shared[at]}
                    yield _batch(columns | {"kind": np.full(len(at), WINDOW_ROW)}, list(_WINDOWS), len(at), _WINDOWS)

    return spans.repartition("least", "salt").sortWithinPartitions("least", "salt").mapInArrow(run, WINDOWS)


def _cut_spans(open_blocks: DataFrame, documents: DataFrame, length: int) -> DataFrame:
    """Open blocks with their text, taken from the records by key."""
    wanted = open_blocks.groupBy("doc").agg(F.collect_list(F.struct("least", "salt", "hot", "first", "count", "many")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part["wanted"]
                owner = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
                flat = pa.RecordBatch.from_struct_array(lists.flatten())
                texts = part["text"].to_pylist()
                first, count = flat["first"].to_numpy(), flat["count"].to_numpy()
                spans = [texts[o][a : a + n - 1 + length] for o, a, n in zip(owner.tolist(), first.tolist(), count.tolist())]
                # of rows of one key, the others' texts may end before a block does
                whole = np.flatnonzero(np.array([len(s) for s in spans], np.int64) == count + (length - 1))
                if len(whole) < len(spans):
                    flat, owner, spans = flat.take(pa.array(whole)), owner[whole], [spans[i] for i in whole]
                columns = [*(flat[c] for c in ("least", "salt", "hot")), part["doc"].take(pa.array(owner)), *(flat[c] for c in ("first", "count", "many")), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["least", "salt", "hot", "doc", "first", "count", "many", "span"])

    return documents.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(
        run, "least bigint, salt int, hot boolean, doc bigint, first bigint, count int, many boolean, span string"
    )


def stretches(intervals: DataFrame) -> DataFrame:
    """Maximal stretches (doc, start, end) of intervals that overlap or touch."""
    order = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = marked.withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("stretch")


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(key, span_start, span_end): the maximal stretches of each record that stand in another one too."""
    if not 1 <= gram <= length:
        raise ValueError("gram must be from 1 to length")
    spark = documents.sparkSession
    null_key = -(1 << 63)
    docs = documents.select(F.coalesce(F.col(key).cast("bigint"), F.lit(null_key)).alias("doc"), F.col(text).alias("text"))
    found = materialize(find_blocks(docs, length, gram), "spans-blocks")

    kinds = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    # A minimum with more than `most` blocks has over half of them in tasks where it collides, as there are
    # at most most / 2 tasks; so the sum over those tasks finds it. There are at most 2 · 100 000 such minima.
    most = max(crowd, 2 * kinds.get(MARK, 0), kinds.get(BLOCK, 0) // 100_000)
    crowded = (
        found.where((F.col("kind") == BLOCK) & (F.col("peers") > 1)).groupBy("least").agg(F.count("*").alias("n"))
        .where(F.col("n") > most // 2).select("least", F.ceil(F.col("n") / most * 2).cast("int").alias("salts")).collect()
    )
    candidates = found.where(F.col("kind") == BLOCK)
    if crowded:
        salts = spark.createDataFrame(crowded, "least bigint, salts int")
        candidates = candidates.join(F.broadcast(salts), "least", "left").withColumn("hot", F.col("salts").isNotNull())
        candidates = candidates.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.col("salts"))).otherwise(0).cast("int"))
    else:
        candidates = candidates.withColumns({"hot": F.lit(False), "salt": F.lit(0)})

    settled = materialize(settle_blocks(candidates, length), "spans-settled")
    windows = settle_windows(_cut_spans(settled.where(F.col("kind") == BLOCK), docs, length), length)
    if crowded:
        windows = materialize(windows, "spans-windows")
        same = Window.partitionBy("window")
        exchanged = (
            windows.where(F.col("kind") == WINDOW_ROW)
            .withColumn("several", (F.min("doc").over(same) != F.max("doc").over(same)) | F.max("many").over(same))
            .where(F.col("several") & ~F.col("many")).select("doc", "start", "end")
        )
        windows = windows.where(F.col("kind") == INTERVAL).select("doc", "start", "end").unionByName(exchanged)
    intervals = (
        found.where(F.col("kind") == INTERVAL).select("doc", F.col("first").alias("start"), F.col("whole").alias("end"))
        .unionByName(settled.where(F.col("kind") == INTERVAL).select("doc", F.col("first").alias("start"), "end"))
        .unionByName(windows.where("start IS NOT NULL").select("doc", "start", "end"))
    )
    return stretches(intervals).select(
        F.when(F.col("doc") != null_key, F.col("doc")).cast(documents.schema[key].dataType).alias(key),
        F.col("start").cast("bigint").alias("span_start"), F.col("end").cast("bigint").alias("span_end"),
    )


def shared_amounts(documents: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every record its length, how many characters are shared, and in how many stretches."""
    amounts = spans.groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count("*").alias("n_spans"))
    sizes = documents.select(key, F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_text_chars"))
    return sizes.join(amounts, key, "left").select(
        key, "n_text_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("n_spans", F.lit(0)).alias("n_spans")
    )
