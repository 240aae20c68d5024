"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Pre-tokenisation works on arrays instead of a regular expression. Each code point has a class; each
class is a function on the states of a small automaton; an associative scan composes these functions
(by table, over the finite monoid that they generate) until every prefix is a constant function,
which is after two doublings for this automaton, however long the text. The states, the classes
and the next class give the boundaries. Distinct slices between them are looked up in a cache that
lasts as long as the Python worker, and only new ones go through pair merging, which merges all new
slices at once, round by round.

Defined cases: null and empty texts give an empty list; strings of special tokens are ordinary text;
texts of any length are encoded whole, in segments cut where a token begins in any context; ids keep
their byte offsets on request, and :meth:`ByteBPE.decode` inverts the encoding exactly.

Slices are told apart by their bytes, never by a hash alone: up to seven bytes and their number fill
one 64-bit word, up to fifteen two, and longer slices are byte strings, which the cache compares in full.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

SEGMENT = 1 << 20  # bytes that are worked on at once
CACHED = 2_000_000  # distinct slices after which a worker's cache starts anew
CACHED_BYTES = 128 << 20  # bytes of long slices after which it does

# Classes of code points, and the states of the automaton after a code point.
EDGE, SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, L_STMD, L_RV, L_L, L_E = range(11)
START, IN_SPACE, IN_WHITE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_QUOTE, QUOTE_RV, QUOTE_L, CLITIC = range(10)
STATES = 10
WHITE_POINTS = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def class_table() -> np.ndarray:
    """The class of each code point, by its general category."""
    major = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((major.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_POINTS] = WHITE
    table[0x20], table[0x27] = SPACE, QUOTE
    for letters, kind in (("stmd", L_STMD), ("rv", L_RV), ("l", L_L), ("e", L_E)):
        for x in letters:
            table[ord(x)] = kind
    return table


def _after(state: int, kind: int) -> int:
    """The state after a code point of class ``kind``."""
    if kind in (EDGE, SPACE, WHITE, LETTER, NUMBER, OTHER):
        return {EDGE: START, SPACE: IN_SPACE, WHITE: IN_WHITE, LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}[kind]
    if kind == QUOTE:  # it begins a token unless a space or other signs precede it
        return IN_OTHERS if state in (IN_SPACE, IN_OTHERS, AT_QUOTE) else AT_QUOTE
    if (state, kind) in ((AT_QUOTE, L_STMD), (QUOTE_RV, L_E), (QUOTE_L, L_L)):
        return CLITIC
    if state == AT_QUOTE and kind in (L_RV, L_L):
        return QUOTE_RV if kind == L_RV else QUOTE_L
    return IN_LETTERS


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(function of each class, composition table, the state a function always gives or 255)."""
    known: dict[tuple[int, ...], int] = {}
    functions: list[tuple[int, ...]] = []

    def index(f: tuple[int, ...]) -> int:
        if f not in known:
            known[f] = len(functions)
            functions.append(f)
        return known[f]

    of_class = [index(tuple(_after(s, k) for s in range(STATES))) for k in range(11)]
    done = 0
    while done < len(functions):
        done = len(functions)
        for f in list(functions):
            for g in list(functions):
                index(tuple(g[s] for s in f))
    n = len(functions)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint8)
    assert n < 256
    constant = np.array([f[0] if len(set(f)) == 1 else 255 for f in functions], np.uint8)
    return np.array(of_class, np.uint8), compose.ravel(), constant


OF_CLASS, COMPOSE, CONSTANT = _monoid()
MONOID = len(CONSTANT)
BEGINS = np.zeros((STATES, 11), bool)  # whether a code point of a class begins a token after a state
for _s in range(STATES):
    for _k in (LETTER, L_STMD, L_RV, L_L, L_E):
        BEGINS[_s, _k] = _s not in (IN_LETTERS, IN_SPACE, QUOTE_RV, QUOTE_L) and _after(_s, _k) != CLITIC
    BEGINS[_s, NUMBER] = _s not in (IN_NUMBERS, IN_SPACE)
    BEGINS[_s, OTHER] = BEGINS[_s, QUOTE] = _s not in (IN_OTHERS, IN_SPACE, AT_QUOTE)


def states(kinds: np.ndarray) -> np.ndarray:
    """The state after each code point; ``kinds`` begins with EDGE."""
    f = OF_CLASS[kinds]
    reach = 1
    while True:
        value = CONSTANT[f]
        if reach >= len(f) or not (value == 255).any():
            return value
        g = f.copy()
        g[reach:] = COMPOSE[f[:-reach].astype(np.uint16) * MONOID + f[reach:]]
        f, reach = g, 2 * reach


def boundaries(kinds: np.ndarray) -> np.ndarray:
    """Where tokens begin, as a mask over ``kinds``, which begins and ends with EDGE."""
    after = states(kinds)
    begin = np.zeros(len(kinds), bool)
    begin[1:] = BEGINS.ravel()[after[:-1].astype(np.uint8) * 11 + kinds[1:]]
    white = (kinds == SPACE) | (kinds == WHITE)
    inner = np.flatnonzero(white[1:-1]) + 1
    begin[inner] = ~white[inner - 1] | (~white[inner + 1] & (kinds[inner + 1] != EDGE))
    clitic = np.flatnonzero((after == CLITIC) & ((kinds == L_E) | (kinds == L_L)))
    begin[clitic - 1] = False  # the first of two letters isn't known to belong to a clitic when it comes
    begin[kinds == EDGE] = False
    return begin


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


NONE = np.int32(1 << 30)


class ByteBPE:
    """A byte-level BPE vocabulary with its merges, its tables and a cache of encoded slices."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        vocabulary = model["vocab"]
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for text, i in vocabulary.items():
            self.pieces[i] = bytes(alphabet[c] for c in text) if all(c in alphabet for c in text) else text.encode()
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.byte_ids[b] = vocabulary[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([[vocabulary[a], vocabulary[b]] for a, b in merges], np.uint32).reshape(-1, 2)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        self._hash_pairs((pairs[:, 0] << np.uint32(16)) | pairs[:, 1])
        self.classes = class_table()
        self._fresh()

    def _hash_pairs(self, keys: np.ndarray) -> None:
        """An open-addressing table from pair to rank, with as many probes as its longest run needs."""
        self.bits, self.probes = 19, 1
        self.slot_key = np.full(1 << self.bits, 0xFFFFFFFF, np.uint32)
        self.slot_rank = np.full(1 << self.bits, NONE, np.int32)
        rank, at = np.arange(len(keys), dtype=np.int32), self._slot(keys).astype(np.int64)
        while len(keys):
            free = self.slot_key[at] == 0xFFFFFFFF
            _, first = np.unique(at[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.slot_key[at[taken]], self.slot_rank[at[taken]] = keys[taken], rank[taken]
            left = np.setdiff1d(np.arange(len(keys)), taken)
            keys, rank, at = keys[left], rank[left], (at[left] + 1) & ((1 << self.bits) - 1)
            self.probes += len(keys) > 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)

    def _fresh(self) -> None:
        self._fresh_cache()
        self.pool = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 14, np.int64)
        self.n_ids = np.zeros(1 << 14, np.int32)

    def __getstate__(self) -> dict:
        keep = ("pieces", "byte_ids", "merged", "bits", "probes", "slot_key", "slot_rank", "classes")
        return {k: self.__dict__[k] for k in keep}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fresh()

    # -- pair merging

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        at = self._slot(keys)
        rank = np.where(self.slot_key[at] == keys, self.slot_rank[at], NONE)
        for probe in range(1, self.probes):
            miss = np.flatnonzero((rank == NONE) & (self.slot_key[at] != 0xFFFFFFFF))
            if not len(miss):
                break
            next_at = (at[miss] + np.uint32(probe)) & np.uint32((1 << self.bits) - 1)
            hit = self.slot_key[next_at] == keys[miss]
            rank[miss[hit]] = self.slot_rank[next_at[hit]]
        return rank

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many slices (their bytes one after another), and how many ids each has.

        In a round every slice merges its pair of least rank, at all places, from the left.
        """
        n = len(lengths)
        tokens = self.byte_ids[data]
        owner = np.repeat(np.arange(n), lengths)
        done_tokens, done_owner = [], []
        while len(tokens):
            rank = np.full(len(tokens), NONE, np.int32)
            same = owner[1:] == owner[:-1]
            rank[:-1][same] = self._ranks(tokens[:-1][same], tokens[1:][same])
            heads = np.flatnonzero(np.concatenate([[True], ~same]))
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(tokens)))
            least_here = np.repeat(least, sizes)
            final = least_here == NONE
            if final.any():
                done_tokens.append(tokens[final])
                done_owner.append(owner[final])
                stay = ~final
                tokens, owner, rank, least_here = tokens[stay], owner[stay], rank[stay], least_here[stay]
                if not len(tokens):
                    break
            hit = rank == least_here
            index = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit, -1, index))
            hit &= (index - run_start) % 2 == 1  # of overlapping pairs every other one
            tokens[hit] = self.merged[rank[hit]]
            stay = np.ones(len(tokens), bool)
            stay[1:] = ~hit[:-1]
            tokens, owner = tokens[stay], owner[stay]
        if not done_tokens:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        tokens, owner = np.concatenate(done_tokens), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return tokens[order], np.bincount(owner, minlength=n)

    # -- slices

    def _slots(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The cache slot of each slice of ``data``; new slices are encoded first."""
        codes, keys, long_bytes = _distinct(data, start, length)
        if len(self.cache) + len(keys) > CACHED or self.long_bytes + long_bytes > CACHED_BYTES:
            self._fresh_cache()
        slot = np.fromiter(map(self.cache.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(slot < 0)
        if len(new):
            first = np.empty(len(keys), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            s, n = start[first[new]], length[first[new]]
            ids, counts = self.merge(data[_ranges(s, n)], n)
            slot[new] = self._keep([keys[i] for i in new.tolist()], ids, counts)
            self.long_bytes += int(n[n > 15].sum())
        return slot[codes]

    def _fresh_cache(self) -> None:
        self.cache: dict[int | bytes, int] = {}
        self.pool_end = self.long_bytes = 0

    def _keep(self, keys: list[int | bytes], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        slots = np.arange(len(self.cache), len(self.cache) + len(keys))
        if slots[-1] >= len(self.at):
            grown = max(2 * len(self.at), int(slots[-1]) + 1)
            self.at, self.n_ids = np.resize(self.at, grown), np.resize(self.n_ids, grown)
        if self.pool_end + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, max(2 * len(self.pool), self.pool_end + len(ids)))
        self.pool[self.pool_end : self.pool_end + len(ids)] = ids
        self.at[slots] = self.pool_end + np.cumsum(counts) - counts
        self.n_ids[slots] = counts
        self.pool_end += len(ids)
        self.cache.update(zip(keys, slots.tolist()))
        return slots

    def _segment(self, data: np.ndarray, cuts: np.ndarray, ids: bool) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text in ``data``, cut at ``cuts``, and the ids if wanted."""
        size, n = len(data), len(cuts) - 1
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.arange(size + 1) if len(points) == size else np.append(np.flatnonzero((data & 0xC0) != 0x80), size)
        # an EDGE before each text and one at the end
        first = cuts if len(points) == size else np.searchsorted(place, cuts)
        kinds = np.full(len(points) + n + 1, EDGE, np.uint8)
        shift = np.repeat(np.arange(1, n + 1), np.diff(first))
        kinds[np.arange(len(points)) + shift] = self.classes[points]
        at = np.flatnonzero(boundaries(kinds))
        edges = first[:-1] + np.arange(n)
        start = place[at - np.searchsorted(edges, at)] if len(at) else np.zeros(0, np.int64)
        length = np.diff(np.append(start, size))
        slot = self._slots(data, start, length)
        counts = self.n_ids[slot].astype(np.int64)
        ends = np.zeros(len(start) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        per_text = np.diff(ends[np.searchsorted(start, cuts)])
        return per_text, self.pool[_ranges(self.at[slot], counts)] if ids else np.zeros(0, np.int32)

    def encode_batch(self, texts: pa.Array, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids one after another)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        size = int(offsets[-1] - offsets[0])
        data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
        cuts, owner = _segments(data, offsets - offsets[0])
        counts, out, a = np.zeros(len(cuts) - 1, np.int64), [], 0
        while a < len(cuts) - 1:
            b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + SEGMENT, "right")) - 1)
            counts[a:b], found = self._segment(data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a], ids)
            out.append(found)
            a = b
        total = np.bincount(owner, weights=counts, minlength=n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)
        return total, np.concatenate(out) if out else np.zeros(0, np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch(pa.array([text], pa.string()))[1].tolist()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the text with these ids."""
        return b"".join(self.pieces[i] for i in ids)

    def offsets(self, ids: list[int]) -> list[tuple[int, int]]:
        """Of each id the bytes of the text that it stands for."""
        ends = np.cumsum([len(self.pieces[i]) for i in ids], dtype=np.int64).tolist()
        return list(zip([0, *ends[:-1]], ends)) if ids else []


_LOW = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)  # masks of the first n bytes of a word


def _distinct(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, list[int | bytes], int]:
    """(number of each slice, the same for equal slices; the key of each number; bytes in keys that are byte strings)."""
    codes, keys = np.empty(len(start), np.int64), []
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    word = np.ndarray(len(data) + 9, np.dtype("<u8"), padded, strides=(1,))  # the eight bytes from each byte on
    sized = length.astype(np.uint64) << np.uint64(56)
    short, long = np.flatnonzero(length < 8), np.flatnonzero(length > 15)
    middle = np.flatnonzero((length > 7) & (length < 16))

    codes[short], found = pd.factorize((word[start[short]] & _LOW[length[short]]) | sized[short])
    keys += found.tolist()
    low, high = word[start[middle]], (word[start[middle] + 8] & _LOW[length[middle] - 8]) | sized[middle]
    (a, lows), (b, highs) = pd.factorize(low), pd.factorize(high)
    both, found = pd.factorize(a * max(1, len(highs)) + b)
    codes[middle] = both + len(keys)
    a, b = np.divmod(found, max(1, len(highs)))
    keys += [x | y << 64 for x, y in zip(lows[a].tolist(), highs[b].tolist())]
    raw, known = data.tobytes() if len(long) else b"", {}
    at = len(keys)
    for i, s, n in zip(long.tolist(), start[long].tolist(), length[long].tolist()):
        codes[i] = known.setdefault(raw[s : s + n], at + len(known))
    return codes, keys + list(known), sum(map(len, known))


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, … (length[0] numbers), start[1], …"""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts at all text ends, and within longer texts before a space between two ASCII letters, where a token begins anyway."""
    lengths = np.diff(offsets)
    cuts, owner = [0], []
    if (lengths <= 2 * SEGMENT).all():
        return offsets, np.arange(len(lengths))
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        at = a
        while b - at > 2 * SEGMENT:
            p = raw.find(b" ", at + SEGMENT, b - 1)
            while p > 0 and not (raw[p - 1 : p].isalpha() and raw[p + 1 : p + 2].isalpha()):
                p = raw.find(b" ", p + 1, b - 1)
            if p < 0:
                break
            cuts.append(p)
            owner.append(i)
            at = p
        cuts.append(b)
        owner.append(i)
    return np.array(cuts, np.int64), np.array(owner, np.int64)


def _encoder(df: DataFrame, vocabulary: str) -> object:
    # 50 257 tokens and fixed tables, about 10 MB whatever the corpus
    return df.sparkSession.sparkContext.broadcast(ByteBPE(vocabulary))


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row; a narrow pass without shuffle."""
    shared = _encoder(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, ids = encoder.encode_batch(part.column(1))
                ends = np.zeros(len(counts) + 1, np.int32)
                np.cumsum(counts, out=ends[1:])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["key", "ids"])

    kind = documents.schema[key].dataType.simpleString()
    out = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row."""
    shared = _encoder(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counts, _ = encoder.encode_batch(part.column(1), ids=False)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts)], names=["key", "n_tokens"])

    kind = documents.schema[key].dataType.simpleString()
    out = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint")
    return out.withColumnRenamed("key", key)
