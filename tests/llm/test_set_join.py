import random

import numpy as np
import pytest
from chronoline.llm import set_join as J

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=5):
    flat = "".join(" " if c in SPACES else c for c in (text or "").translate(LOWER))
    words = [w for w in flat.split(" ") if w]
    return frozenset(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, percent=80):
    """Every pair of rows."""
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label[root(i)] = root(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc_id)
    least = {r: min((x for x in own if x is not None), default=None) for r, own in ids.items()}
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def joined(docs, **kw):
    return sorted((tuple(r) for r in J.join_sets(docs, **kw).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def family(r, words, edits, n):
    """Texts some edits apart, so that links form chains."""
    text = [f"w{r.randrange(4000)}" for _ in range(words)]
    out = [text]
    for _ in range(n - 1):
        own = list(r.choice(out))
        for _ in range(r.randint(0, edits)):
            own[r.randrange(len(own))] = f"e{r.randrange(10**6)}"
        out.append(own)
    return [" ".join(t) for t in out]


def made(seed):
    r = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [t for _ in range(8) for t in family(r, r.choice([6, 30, 120, 300]), r.choice([1, 3, 6]), r.randint(2, 12))]
    texts += family(r, 150, 4, 60)
    texts += [" ".join(f"u{r.randrange(10**6)}" for _ in range(r.randint(5, 60))) + " " + passage for _ in range(60)]
    texts += [passage, passage.upper(), passage.replace(" ", "\n"), passage + " tail of one"] + ["a b c", "A b\tC", "", None, " "]
    r.shuffle(texts)
    return list(enumerate(texts))


SMALL = {"HOT_ROWS": 3, "LIST_ROWS": 5, "GROUP_ROWS": 20, "AT_ONCE": 500, "SHARD_SHINGLES": 1000, "BUNDLE_SHINGLES": 2000}


@pytest.mark.parametrize("bounds", [{}, SMALL, {"HOT_ROWS": 10**9, "LIST_ROWS": 2, "GROUP_SHINGLES": 3000}, {"HOT_MOST": 10, "LIST_ROWS": 4}])
def test_equals_brute_force_whatever_the_bounds(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(J, name, value)
    rows = made(len(bounds))
    assert joined(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)) == brute(rows)


def test_other_similarities(spark):
    rows = made(7)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert joined(docs, percent=50) == brute(rows, 50)


def exact_labels(sets, percent):
    label = np.arange(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            met = len(np.intersect1d(a, sets[j]))
            if 100 * met >= percent * (len(a) + len(sets[j]) - met):
                label[label == label[i]] = label[j]
    _, first, at = np.unique(label, return_index=True, return_inverse=True)
    return first[at]


@pytest.mark.parametrize("percent", [80, 60])
def test_a_cluster_derives_and_skips_and_stays_exact(percent):
    r = np.random.default_rng(percent)
    derived = skipped = 0
    for _ in range(40):
        sets = []
        for _ in range(r.integers(1, 4)):
            core = r.integers(0, 2**63, r.integers(1, 80), dtype=np.uint64)
            for _ in range(r.integers(1, 12)):
                own = core[r.random(len(core)) > r.choice([0, 0.1, 0.3])]
                sets.append(np.unique(np.r_[own, r.integers(0, 300, r.integers(1, 1 + max(1, len(core) // 6)), dtype=np.uint64)]))
        cluster = J.Cluster(sets, np.arange(len(sets)), percent)
        assert cluster.run().tolist() == exact_labels(sets, percent).tolist()
        derived, skipped = derived + cluster.derived, skipped + cluster.skipped
    assert derived > 20 and skipped > 20


def test_derived_overlaps_are_those_counted_anew():
    r = np.random.default_rng(1)
    core = np.unique(r.integers(0, 10**6, 200, dtype=np.uint64))
    sets = [np.unique(np.r_[core[r.random(len(core)) > 0.1], r.integers(0, 10**6, 9, dtype=np.uint64)]) for _ in range(20)]
    cluster = J.Cluster(sets, np.arange(20))
    cluster.lead(3)
    for i in range(20):
        assert (cluster.derive(i, 3) == cluster._tallied(cluster.set_of(i))).all()


def test_near_copies_cost_few_searches():
    """A clump of near copies joins by one search; it is not compared pair by pair."""
    r = np.random.default_rng(2)
    core = np.unique(r.integers(0, 2**63, 300, dtype=np.uint64))
    sets = [np.unique(np.r_[np.delete(core, r.integers(0, len(core), 5)), r.integers(0, 2**63, 5, dtype=np.uint64)]) for _ in range(500)]
    cluster = J.Cluster(sets, np.arange(500))
    calls = []
    keep = cluster.search
    cluster.search = lambda i: (calls.append(i), keep(i))[1]
    assert set(cluster.run().tolist()) == {0} and len(calls) == 1


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert joined(odd_docs) == brute(rows)
    assert joined(no_docs) == []
    clash = odd_docs.selectExpr("*", "'x' as key", "'x' as node", "'x' as root", "'x' as odd_id", "'x' as n")
    assert joined(clash) == brute(rows)
    negative = [(-3, "one two three four five six"), (3, "one two three four five six"), (None, "ONE two three four five six"), (None, "seven")]
    assert joined(spark.createDataFrame(negative, "doc_id bigint, text string")) == brute(negative)


def test_parity_bits_never_rule_out_a_link():
    r = np.random.default_rng(4)
    ruled_out = 0
    for _ in range(300):
        core = r.integers(0, 2**63, r.integers(1, 200), dtype=np.uint64)
        a, b = (np.unique(np.r_[core[r.random(len(core)) > r.choice([0, 0.05, 0.2, 0.6])], r.integers(0, 2**63, r.integers(0, 12), dtype=np.uint64)]) for _ in range(2))
        met = len(np.intersect1d(a, b))
        near = J.may_reach(J.parity_bits(a), J.parity_bits(b), len(a), len(b))
        assert near or 100 * met < 80 * (len(a) + len(b) - met)
        ruled_out += not near
    assert ruled_out > 50


def test_shingles_are_told_apart_as_words_are():
    assert len(J.shingle_hashes("a b c d e f", 5)) == 2
    assert (J.shingle_hashes("A b\tC", 5) == J.shingle_hashes("a b c", 5)).all() and len(J.shingle_hashes("a b c", 5)) == 1
    assert J.shingle_hashes("a b", 5) != J.shingle_hashes("b a", 5) and J.shingle_hashes("a a", 5) != J.shingle_hashes("a a a", 5)
    assert len(J.shingle_hashes(" \n", 5)) == len(J.shingle_hashes(None, 5)) == 0
