import hashlib
import random
import zlib

import numpy as np
import pytest
from chronoline.llm import periodic_runs as P
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"


def brute(words, exponent=4, least=6):
    """Every period by a walk over the words; a stretch inside one of a smaller period does not have its own as the smallest."""
    found = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, exponent * q) and not any(s <= i and s + m >= i + n for s, m, _ in found):
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(r):
    n, k = r.randint(0, 90), r.choice([1, 2, 2, 3, 5])
    words = [r.randrange(k) for _ in range(n)]
    if n and r.random() < 0.6:
        a = r.randrange(n)
        p = 1 + (n - a) // r.randint(3, 10)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words * r.choice([1, 1, 1, 3])


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 2), (3, 1)])
def test_runs_equal_brute_force(exponent, least):
    r = random.Random(exponent)
    for _ in range(150):
        texts = [some_words(r) for _ in range(r.randint(1, 6))]
        got = P.find_runs(np.array([w for t in texts for w in t], dtype=np.int64), np.array(list(map(len, texts)), dtype=np.int64), exponent, least)
        assert got.tolist() == [[k, *run] for k, t in enumerate(texts) for run in brute(t, exponent, least)]


def test_a_position_moves_a_logarithmic_number_of_times(monkeypatch):
    """Fibonacci words have runs of every scale; the moves stay within n log n."""
    moved, a, b = [], [0], [0, 1]
    keep = P.Classes._move
    monkeypatch.setattr(P.Classes, "_move", lambda self, gone, *rest: (moved.append(len(gone)), keep(self, gone, *rest))[1])
    while len(b) < 3000:
        a, b = b, b + a
    runs = P.find_runs(np.array(b), np.array([len(b)]), 2, 2)
    assert runs[:, 1:].tolist() == [list(x) for x in brute(b, 2, 2)]
    assert sum(moved) <= 2 * len(b) * np.log2(len(b))


def contract(doc_id, text, plant):
    words = [w for w in "".join(" " if c in WHITE else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    lost = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in lost)
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept))


def answered(docs, plant):
    form = docs.select("doc_id", P.planted(F.col("doc_id"), F.col("text")).alias("text")) if plant else docs
    return sorted((tuple(r) for r in P.run_digests(P.periodic_runs(form)).collect()), key=repr)


@pytest.mark.parametrize("plant", [True, False])
def test_query_columns_equal_the_contract(spark, plant):
    r = random.Random(9)
    rows = [(i, r.choice([" ", "\n", " \t"]).join(map(str, some_words(r)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert answered(docs, plant) == sorted((contract(i, t, plant) for i, t in rows), key=repr)


def test_equal_exponents_take_the_first_run(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b x c d c d c d c d y e e e e e e")], "doc_id bigint, text string")
    (row,) = answered(docs, False)
    assert row[1:6] == (3, 18, 6, 1, 6000)
    (row,) = answered(docs.selectExpr("doc_id", "replace(text, 'e', 'f g') as text"), False)
    assert row[1:6] == (3, 18, 12, 2, 6000)
    (row,) = answered(spark.createDataFrame([(1, "a b a b a b a b x c d c d c d c d")], "doc_id bigint, text string"), False)
    assert row[1:6] == (2, 0, 8, 2, 4000)


def test_odd_rows(odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(P, "WORDS_AT_ONCE", 10)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    few = [(i, t) for i, t in rows if len(t or "") < 10_000]
    got = answered(odd_docs, True)
    assert len(got) == len(rows)
    assert [g for g in got if g[0] != 3] == sorted((contract(i, t, True) for i, t in few), key=repr)
    assert answered(no_docs, True) == []
