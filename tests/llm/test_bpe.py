import random

import numpy as np
import pyarrow as pa
import pytest

from profloom.llm import bpe


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe.ByteBPE(vocabulary)


@pytest.fixture(scope="module")
def reference(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def split(encoder, texts):
    counts, ids = encoder.encode_batch(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for c, e in zip(counts, ends)]


PARTS = ["'", "s", "t", "re", "ve", "ll", "l", "r", "v", "e", "m", "d", "'S", " ", "  ", "\n", "\r\n", "\t", "a", "Z", "1", "９", "½", "!", "--", "é", " ", "　", "​", "\x1c", "\x85", "中", "<|endoftext|>", "😀", "́", "�", "﻿", "\x00"]


def test_random_texts(encoder, reference):
    random.seed(1)
    texts = ["".join(random.choice(PARTS) for _ in range(random.randint(0, 14))) for _ in range(30_000)]
    assert split(encoder, texts) == reference(texts)


def test_every_code_point(encoder, reference):
    texts = [f"a{chr(c)}1{chr(c)}! {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 200_000):
        assert split(encoder, texts[at : at + 200_000]) == reference(texts[at : at + 200_000])


def test_defined_cases(encoder, reference):
    assert split(encoder, [None, "", " ", None]) == [[], [], [220], []]
    assert encoder.encode(None) == [] and encoder.encode_batch(pa.array([], pa.string()))[0].tolist() == []
    assert 50256 not in encoder.encode("<|endoftext|>")
    assert split(encoder, pa.array(["x", "skip", "héllo"]).slice(2).to_pylist()) == reference(["héllo"])
    counts, ids = encoder.encode_batch(pa.array(["x", None, "héllo wörld"]).slice(1))
    assert counts.tolist() == [0, len(ids)] and ids.tolist() == reference(["héllo wörld"])[0]


@pytest.mark.parametrize("text", ["a" * 300_000, "=" * 100_001, "ab" * 70_000, " " * 50_000 + "x", "word " * 60_000, "0123456789" * 9_000])
def test_long_texts(encoder, reference, text):
    assert split(encoder, [text]) == reference([text])


def test_segments_do_not_matter(encoder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 50)
    random.seed(2)
    texts = [" ".join(random.choice(["don't", "été", "12", "x", "  ", "!?", "abc"]) for _ in range(random.randint(0, 300))) for _ in range(300)]
    assert split(encoder, texts) == reference(texts)


def test_a_small_cache_gives_the_same(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 50)
    e = bpe.ByteBPE(vocabulary)
    texts = [f"number {i} and word{i * 7919}" for i in range(2000)]
    got = [ids for t in range(0, 2000, 20) for ids in split(e, texts[t : t + 20])]
    assert got == reference(texts)


def test_round_trip_and_offsets(encoder):
    text = "Grüße, it's 12 o'clock 😀\n\n  ok\x00�"
    ids = encoder.encode(text)
    assert encoder.decode(ids).decode() == text
    raw, spans = text.encode(), encoder.offsets(ids)
    assert b"".join(raw[a:b] for a, b in spans) == raw and spans[-1][1] == len(raw) and encoder.offsets([]) == []


def test_scan_is_associative():
    """The scan's states equal those of a walk, whatever the sequence of classes."""
    rng = np.random.default_rng(5)
    kinds = np.concatenate([[bpe.EDGE], rng.integers(1, 11, 20_000)]).astype(np.uint8)
    state, walked = bpe.START, []
    for k in kinds:
        state = bpe._after(state, int(k))
        walked.append(state)
    assert bpe.states(kinds).tolist() == walked


def test_corpus(spark, documents, reference):
    rows = documents.select("doc_id", "text").collect()
    expected = dict(zip((r["doc_id"] for r in rows), reference([r["text"] or "" for r in rows])))
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(documents).collect()}
    assert got == expected
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(documents).collect()} == {k: len(v) for k, v in expected.items()}


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x", 0), (None, None, "y", 0)], "doc_id bigint, text string, ids string, key int")
    assert sorted(map(tuple, bpe.encode_corpus(df).collect()), key=repr) == sorted([(1, [64, 275]), (None, [])], key=repr)
    assert bpe.encode_corpus(df.limit(0)).collect() == []
    named = df.select("key", "text", "doc_id")
    assert bpe.count_tokens(named, key="key").columns == ["key", "n_tokens"]


def _alternation(n):
    """A word of n letters and its complement: sums of their letters over powers of any odd base agree modulo 2^64 from 1 024 letters on."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_slices_are_told_apart_by_their_bytes(vocabulary, reference, n):
    word, complement = _alternation(n)
    for texts in ([word, complement], [complement, word], [word + " " + complement, complement + " " + word]):
        assert split(bpe.ByteBPE(vocabulary), texts) == reference(texts)
        apart = bpe.ByteBPE(vocabulary)
        assert [apart.encode(t) for t in texts] == reference(texts)


def test_slices_of_every_length(encoder, reference):
    texts = ["x" * n + end for n in range(40) for end in ("", "y", "\x00", "\x00\x00", "é")] + ["\x00" * n for n in range(40)]
    assert split(encoder, texts) == reference(texts)
    assert [encoder.encode(t) for t in texts] == reference(texts)


def test_long_slices_start_the_cache_anew(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_BYTES", 3000)
    e = bpe.ByteBPE(vocabulary)
    texts = ["ab" * n for n in range(500, 540)] * 2
    assert [e.encode(t) for t in texts] == reference(texts)
