import random
import re
from collections import Counter

import pytest
from chronoline.llm import divergence_audit as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, top=200):
    """The contract's sums, term by term."""
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in held.items() if n >= min_docs}
        counts = {}
        for d in docs:
            if d[0] == lang:
                counts.setdefault(d[1], Counter()).update(t for t in d[2] if t in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        f = lambda p, q: (p - q) * (p - q) // q
        for source, c in counts.items():
            pairs = [(o, sum(f(share(c, t), share(x, t)) for t in kept)) for o, x in counts.items() if o != source]
            terms = [(t, f(share(c, t), share(whole, t))) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def audited(docs, **kw):
    return sorted(tuple(r) for r in D.audit_sources(docs, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


def made(n=120, seed=3):
    r = random.Random(seed)
    terms = ["the", "Of", "ÉTÉ", "été", "naïve", "x9y", "z"] + [f"w{'abcdefgh'[k % 8]}{'ijklm'[k % 5]}{'nopqrst'[k % 7]}" for k in range(60)]
    text = lambda: r.choice([" ", "\x00", "_", "9"]).join(r.choice(terms[: r.choice([4, 20, 67])]) for _ in range(r.randint(0, 40)))
    return [(r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "é", None]), r.choice([text(), text(), text(), None])) for _ in range(n)]


@pytest.mark.parametrize("bounds", [{}, {"TERMS_AT_ONCE": 5, "SOURCE_BLOCK": 2, "SHARD_ROWS": 7}])
def test_equals_brute_force_however_it_is_cut(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(D, name, value)
    rows = made()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert audited(docs, top=11) == brute(rows, top=11)


def test_cells_hold_every_kept_term_once(spark):
    docs = spark.createDataFrame(made(), "lang string, source string, text string")
    counts = D.kept_counts(docs)
    sources = D.source_totals(counts)
    v = {r["lang"]: r["v"] for r in sources.collect()}
    cells = D.joint_cells(counts, sources).collect()
    total = Counter()
    for r in cells:
        assert r["n"] > 0
        total[r["lang"], r["a"], r["b"]] += r["n"]
    assert total and all(n == v[k[0]] for k, n in total.items())
    assert len({(r["lang"], r["a"], r["b"], r["ca"], r["cb"]) for r in cells}) == len(cells)


def test_groups_without_kept_terms_pair_at_zero(spark):
    docs = spark.createDataFrame([("en", "a", "one"), ("en", "b", None), ("de", "a", "")], "lang string, source string, text string")
    assert audited(docs) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_odd_rows(odd_docs, no_docs):
    docs = odd_docs.selectExpr("*", "'clash' as term", "'clash' as at", "'clash' as count").drop("source").selectExpr("*", "if(doc_id % 2 = 0, 'x', null) as source")
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    assert audited(docs) == brute(rows)
    assert audited(no_docs) == []


def test_values_past_the_range_of_long_products(spark):
    """Counts of a billion would overflow 10**9 * (count + 1) in long."""
    row = spark.sql(f"select {D._share('c', 't')} as p from values (20000000000L, 30000000000L) as v(c, t)").first()
    assert row["p"] == 1 + 1_000_000_000 * 20_000_000_001 // 30_000_000_000
