import random

import pytest
from chronoline.llm import line_dedup as L


def brute(rows, min_chars=40, min_docs=5):
    """The contract's own words: documents that hold a key are distinct ids, and each but the largest loses the line."""
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= min_chars and doc_id is not None:
                holders.setdefault(key, set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
            ids = holders.get(key, set())
            if len(ids) < min_docs or doc_id is None or doc_id == max(ids):
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def ran(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in df.collect()), key=repr)


@pytest.mark.parametrize("bits", [L.MAX_FILTER_BITS, 64])
def test_equals_brute_force_whatever_the_filter_size(spark, bits, monkeypatch):
    monkeypatch.setattr(L, "MIN_FILTER_BITS", 1 << 19 if bits > 64 else L.SLICE_BITS)
    r = random.Random(1)
    pool = [f"shared line number {k} that is surely longer than forty characters é" for k in range(30)] + ["short", "", "  "]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.5 else f"own line {r.random()} of document {i} with a long enough tail" for _ in range(r.randint(0, 12)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert ran(L.dedup_lines(df, max_filter_bits=max(bits, L.SLICE_BITS))) == brute(rows)


def test_merge_saturates_and_is_associative():
    import numpy as np

    r = np.random.default_rng(0)
    f = [L.TwoFilters(L.SLICE_BITS) for _ in range(3)]
    sets = [r.integers(0, 2**63, 50, dtype=np.uint64) for _ in range(3)]
    sets[1][:10] = sets[0][:10]
    for a, b in zip(f, sets):
        a.add(b)
    left = L.merge(L.merge(f[0].seen, f[1].seen), f[2].seen)
    assert (left == L.merge(f[0].seen, L.merge(f[1].seen, f[2].seen))).all()
    for at in L.positions(sets[0][:10], L.SLICE_BITS):
        assert (((left[(at >> np.uint64(2)).astype(int)] >> ((at & np.uint64(3)) * 2 + 1).astype(np.uint8)) & 1) == 1).all()


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    out = L.dedup_lines(odd_docs)
    assert ran(out) == brute(rows)
    assert set(odd_docs.columns) - {"n_lines"} <= set(out.columns)
    assert L.dedup_lines(no_docs).count() == 0


def test_repeated_and_missing_ids_are_counted_as_the_contract_says(spark):
    line = "a line of more than forty characters that several rows hold"
    rows = [(1, line)] * 4 + [(2, line), (None, line), (None, line)]  # two documents hold it
    assert all(r["n_dropped"] == 0 for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    rows += [(3, line), (4, line), (5, line), (5, "other\n" + line)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(70)  # over MERGE_FAN tasks
    out = ran(L.dedup_lines(df))
    assert out == brute(rows) and sum(r[2] for r in out) == 7
