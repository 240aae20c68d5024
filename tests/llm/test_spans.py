import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from profloom.llm import spans


def brute(docs, length):
    seen = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - length + 1):
            seen[t[i : i + length]].add(d)
    out = []
    for d, t in docs:
        now = None
        for i in range(len(t or "") - length + 1):
            if len(seen[t[i : i + length]]) > 1:
                if now and i <= now[1]:
                    now[1] = i + length
                else:
                    out += [(d, *now)] if now else []
                    now = [i, i + length]
        out += [(d, *now)] if now else []
    return sorted(out, key=repr)


def run(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    return sorted(map(tuple, spans.shared_spans(df, **options).collect()), key=repr)


def corpus(seed, n=120):
    random.seed(seed)
    bits = ["".join(random.choice("abé𝄞 ") for _ in range(random.randint(1, 45))) for _ in range(10)]
    return [(i, None if random.random() < 0.05 else "".join(random.choice(bits) for _ in range(random.randint(0, 12))) + "x" * random.randint(0, 60)) for i in range(n)]


@pytest.mark.parametrize("crowd", [1, 3, 20_000])
@pytest.mark.parametrize("gram", [1, 12, 30])
def test_random_texts(spark, crowd, gram):
    docs = corpus(gram)
    assert run(spark, docs, length=30, gram=gram, crowd=crowd) == brute(docs, 30)


def test_defined_cases(spark):
    long = "".join(chr(97 + (i * i) % 23) for i in range(300))
    assert run(spark, [(1, None), (2, ""), (3, "short")]) == []
    assert run(spark, []) == []
    assert run(spark, [(1, long + "--" + long), (2, "other" * 60)]) == []
    assert run(spark, [(1, long), (2, long)]) == [(1, 0, 300), (2, 0, 300)]
    assert run(spark, [(1, "😀é" + long[:200]), (2, "z" + long[:200] + "z"), (3, long[1:200])]) == [(1, 2, 202), (2, 1, 201)]
    assert run(spark, [(None, long), (5, long), (None, "x")]) == [(5, 0, 300), (None, 0, 300)]
    assert run(spark, [(1, "a" * 1000), (2, "a" * 300)]) == [(1, 0, 1000), (2, 0, 300)]
    with pytest.raises(ValueError):
        run(spark, [], gram=500)


def test_rows_of_one_key_are_one_record(spark):
    random.seed(9)
    a, b = ("".join(random.choice("abcdefgh") for _ in range(260)) for _ in range(2))
    assert run(spark, [(1, a), (1, a)]) == []
    assert run(spark, [(1, a), (1, a), (2, "x" + a)]) == [(1, 0, 260), (2, 1, 261)]
    assert run(spark, [(1, a + b), (1, "short"), (2, "x" + a[:230] + "y"), (3, a[10:])])[0] == (1, 0, 260)


def test_stretches_that_touch_are_one(spark):
    random.seed(3)
    a, b = ("".join(random.choice("abcdefgh") for _ in range(200)) for _ in range(2))
    assert run(spark, [(1, a + b), (2, a + "!"), (3, "?" + b)]) == [(1, 0, 400), (2, 0, 200), (3, 1, 201)]


def test_a_third_of_all_records_share_a_text(spark):
    random.seed(4)
    word = lambda n: "".join(random.choice("abcdefghij ") for _ in range(n))
    common = word(400)
    docs = [(i, word(150) + (common if i % 3 == 0 else "") + word(150)) for i in range(300)]
    for crowd in (10, 20_000):
        got = run(spark, docs, crowd=crowd)
        assert len(got) == 100 and all(b - a >= 400 for _, a, b in got) and got == brute(docs, 200)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(spans, "CHUNK", 500)
    random.seed(5)
    base = "".join(random.choice("abcdefghijklmnop") for _ in range(6000))
    docs = [(1, base), (2, "?" * 37 + base[100:5500] + "!" * 40), (3, base[3000:3250])]
    assert run(spark, docs) == brute(docs, 200)


def test_least_of_windows():
    x = np.random.default_rng(1).integers(0, 50, 400)
    for w in (1, 2, 3, 7, 64, 100):
        assert spans._least(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


def test_slices_have_the_hash_of_their_text():
    h, _ = spans._hashers()
    text = "abracadabra" * 30
    h.load(spans._points([text]))
    one = h.of(np.array([3]), np.array([30]))[0]
    h.load(spans._points(["zzz", text[3:30], "q"]))
    assert h.of(np.array([3]), np.array([30]))[0] == one == h.all(27)[3]


def test_documents(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    clash = documents.select("doc_id", "text", *(F.lit(1).alias(c) for c in ("doc", "start", "end", "least", "hot", "salt", "kind")))
    expected = brute(docs, 200)
    assert sorted(map(tuple, spans.shared_spans(clash).collect()), key=repr) == expected
    amounts = {r["doc_id"]: r for r in spans.shared_amounts(documents, spans.shared_spans(documents)).collect()}
    assert len(amounts) == len(docs) and sum(r["shared_chars"] for r in amounts.values()) == sum(b - a for _, a, b in expected)
