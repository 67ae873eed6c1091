import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from chronoline.llm import similarity as M
from chronoline.llm import simhash as S
from chronoline.llm.components import components


def roots(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def slow_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd_docs):
    texts = [r["text"] for r in odd_docs.where("doc_id <> 3 or doc_id is null").collect()] + ["A b C d e", "a B c D e", "one two"]
    for t in texts:
        assert S.fingerprint(t) == slow_print(t)
    assert S.fingerprint(None) == 0 == S.fingerprint(" \n")


def clustered(n, seed):
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = r.choice(out)
        for _ in range(r.randint(1, 3)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return sorted(set(out))


def test_search_finds_every_component(spark):
    prints = np.array(clustered(1500, 1), dtype=np.uint64)
    near = [(i, j) for i in range(len(prints)) for j in np.flatnonzero(S.distance(prints[i + 1 :], prints[i]) <= 2) + i + 1]
    want = roots(len(prints), near)
    a, b = S.search(prints, np.arange(len(prints)), np.empty(0, dtype=np.int64), 2)
    assert roots(len(prints), zip(a.tolist(), b.tolist())) == want
    tree, shards = S.build_tree(prints[::7], 16)
    dealt = list(S.route(tree, prints, np.arange(len(prints)), np.empty(0, dtype=np.int64), 2))
    assert len(dealt) == shards > 8 and sorted(np.concatenate([h for _, h, _ in dealt])) == list(range(len(prints)))
    links = [(int(x), int(y)) for _, h, v in dealt for x, y in zip(*S.search(prints, h, v, 2))]
    assert roots(len(prints), links) == want
    df = spark.createDataFrame([(int(np.int64(np.uint64(f))) if f < 2**63 else int(f) - 2**64, i) for i, f in enumerate(map(int, prints))], "fp bigint, id bigint")
    got = [(r["a"], r["b"]) for r in S.links(df, 2, sample_nodes=600, shard_nodes=200).collect()]
    assert roots(len(prints), got) == want


def test_large_shards_are_cut_again(spark, monkeypatch):
    """A first tree of two leaves from sixteen fingerprints: its shards come out too large and are cut until they fit."""
    monkeypatch.setattr(S, "RECUT_OVER", 4)
    prints = np.array(clustered(1500, 2), dtype=np.uint64)
    near = [(i, j) for i in range(len(prints)) for j in np.flatnonzero(S.distance(prints[i + 1 :], prints[i]) <= 2) + i + 1]
    df = spark.createDataFrame([(int(f), i) for i, f in enumerate(prints.view(np.int64))], "fp bigint, id bigint").repartition(3)
    got = [(r["a"], r["b"]) for r in S.links(df, 2, sample_nodes=16, shard_nodes=100).collect()]
    assert roots(len(prints), got) == roots(len(prints), near)
    cut = []
    kept = S._recut
    monkeypatch.setattr(S, "_recut", lambda dealt, *rest: cut.append(kept(dealt, *rest)) or cut[-1])
    S.links(df, 2, sample_nodes=16, shard_nodes=100)
    sizes = [len(r["home"]) + len(r["visit"]) for r in cut[0].selectExpr("shard", "home", "visit").collect()]
    shards = {r["shard"] for r in cut[0].select("shard").collect()}
    assert len(shards) > 8 and max(sizes) // 16 <= 400 and min(shards) >= S._SPAN


def test_components_of_chains_and_stars(spark):
    r = random.Random(0)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    want = roots(300, links)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert [got.get(i, i) for i in range(300)] == want
    rounds = components(spark.createDataFrame(links, "a bigint, b bigint").repartition(9), one_task=0)
    assert {x["node"]: x["root"] for x in rounds.collect()} == got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    out = S.near_duplicates(odd_docs).collect()
    assert len(out) == odd_docs.count() and all(len(r["fingerprint"]) == 16 for r in out)
    by = {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None}
    assert by[0] == by[1] == by[2] == 0 and by[4] == by[5] == by[9] == 4
    assert S.near_duplicates(no_docs).count() == 0


def test_similar_groups_equal_exact_jaccard(spark):
    r = random.Random(11)
    word = lambda: f"w{r.randrange(5000)}"
    texts = []
    for _ in range(60):
        base = [word() for _ in range(r.randint(30, 200))]
        texts.append(base)
        for _ in range(r.randint(0, 3)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = word()
            texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    similarity = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    pairs = {(i, j): similarity(i, j) for i in range(len(texts)) for j in range(i) if sets[i] & sets[j]}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {x["doc_id"]: x["component_id"] for x in M.similar_groups(df).collect()}
    for (i, j), s in pairs.items():
        if s >= 0.8:
            assert got[i] == got[j]
    loose = roots(len(texts), [p for p, s in pairs.items() if s >= 0.74])
    assert all(loose[i] == loose[c] for i, c in got.items())


def test_similar_groups_of_hot_routes(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP_ROWS", 40)
    base = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join([*base[:150], f"own{i}", *base[151:]])) for i in range(150)] + [(1000, "something else entirely of its own")]
    got = {x["doc_id"]: x["component_id"] for x in M.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {**{i: 0 for i in range(150)}, 1000: 1000}


def test_rest_of_a_hot_route_is_compared_with_all_of_it(spark, monkeypatch):
    """One route for all: pairs that fall into different salted groups, and that no pivot joins, are found in the second pass."""
    monkeypatch.setattr(M, "GROUP_ROWS", 25)
    r = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join([*base[:100], f"own{i}", *base[101:]]) for i in range(60)]
    for _ in range(50):
        lone = [f"x{r.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(lone), " ".join([*lone[:50], "changed", *lone[51:]])]
    hashes = [M.shingle_hashes(t, 5) for t in texts]
    rows = [(i, int(np.uint64(fp).view(np.int64)), len(h), parts, values, h.tobytes()) for i, h in enumerate(hashes) for fp, parts, values in [M.sketch(h)]]
    table = spark.createDataFrame(rows, "id bigint, fp bigint, n bigint, parts array<bigint>, sketch binary, hashes binary")
    nodes, sets = table.drop("hashes"), table.select("id", "hashes")
    clumps = table.selectExpr("1 as mask", "cast(7 as bigint) as key", "id", "n")
    none = spark.createDataFrame([], "node bigint, root bigint")
    monkeypatch.setattr(M, "PIVOTS", 1)
    found = components(M.clump_links(clumps, nodes, sets, 0.8, none))
    label = {x["node"]: x["root"] for x in found.collect()}
    assert {i: label.get(i, i) for i in range(160)} == {i: 0 if i < 60 else i - i % 2 for i in range(160)}


def test_similarity_is_exact_at_the_threshold(spark):
    """Texts of thousands of words and of a dozen, at exactly 0.8 and just under it."""
    r = random.Random(8)
    rows, want = [], {}
    for n, common in [(2250, 2000)] * 30 + [(2250, 1999)] * 30 + [(9, 8)] * 60 + [(18, 15)] * 60:
        words = [f"w{r.randrange(10**9)}" for _ in range(n + 4)]
        other = words[: common + 4] + [f"w{r.randrange(10**9)}" for _ in range(n - common)]
        at = len(rows)
        rows += [(at, " ".join(words)), (at + 1, " ".join(other))]
        want |= {at: at, at + 1: at if common / (2 * n - common) >= 0.8 else at + 1}
    got = {x["doc_id"]: x["component_id"] for x in M.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), max_bits=0).collect()}
    assert got == want


@pytest.mark.parametrize("small", [1, M.SMALL_ROWS])
def test_undecided_pairs_in_bundles_and_large_groups(spark, monkeypatch, small):
    """A text with four partners at exactly 0.8 and four just under it."""
    monkeypatch.setattr(M, "SMALL_ROWS", small)
    base = [f"w{k}" for k in range(2254)]
    texts = [base]
    for k in range(8):
        begin, n = 10 + 275 * k, 246 + k % 2
        texts.append([*base[:begin], *(f"own{k}x{i}" for i in range(n)), *base[begin + n :]])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    near = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert len(near) >= 4
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {x["doc_id"]: x["component_id"] for x in M.similar_groups(table, max_bits=0).collect()}
    assert [got[i] for i in range(len(texts))] == roots(len(texts), near)


@pytest.mark.parametrize("rows", [M.GROUP_ROWS, 12])
def test_groups_equal_exact_jaccard_on_the_documents(spark, monkeypatch, rows):
    """All pairs at 0.8 or more of the whole table by an inverted index; with small bounds groups are taken apart, and clumps searched in blocks."""
    monkeypatch.setattr(M, "GROUP_ROWS", rows)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: frozenset(S.shingles(r["text"], 5)) for r in docs.collect()}
    ids = sorted(sets)
    at = {d: i for i, d in enumerate(ids)}
    held = defaultdict(list)
    for d in ids:
        for gram in sets[d]:
            held[gram].append(d)
    common = Counter()
    for own in held.values():
        common.update((x, y) for i, x in enumerate(own) for y in own[i + 1 :])
    pairs = [(at[x], at[y]) for (x, y), n in common.items() if n / (len(sets[x]) + len(sets[y]) - n) >= 0.8]
    pairs += [(at[x], at[y]) for x, y in zip([d for d in ids if not sets[d]], [d for d in ids if not sets[d]][1:])]
    want = roots(len(ids), pairs)
    got = {x["doc_id"]: x["component_id"] for x in M.similar_groups(docs, max_bits=0).collect()}
    assert len(pairs) > 50
    met = sum(got[ids[i]] == got[ids[j]] for i, j in pairs)
    assert met >= 0.99 * len(pairs)
    assert all(want[at[d]] == want[at[c]] for d, c in got.items())  # nothing joined that exact pairs do not join


def test_keep_one_row_of_each_group(spark, odd_docs, no_docs):
    out = M.keep_one(odd_docs)
    assert out.dtypes == odd_docs.dtypes
    norm = lambda t: " ".join((t or "").lower().split(" ")).strip(" \n\t\r")
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len({norm(t) for _, t in kept}) == len(kept)
    # one line and that line with two words more have eight of ten shingles in common
    assert {d for d, _ in kept} == {0, 3, 4, 10, 11, 12, None} and (None, "no id") in kept
    rows = [(None, "same words of a text")] * 5 + [(7, "same words of a text")] * 3 + [(7, "another text of the same id"), (9, "another text of the same id")]
    got = M.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(7, "another text of the same id"), (7, "same words of a text")]
    assert M.keep_one(no_docs).count() == 0


def apart_in_parts(name, but=()):
    """A text and its near copy, at over 0.8, that lacks the text's least shingle of every part but those given; and these shingles by part."""
    words = [f"{name}{i}" for i in range(504)]
    grams = [" ".join(words[i : i + 5]) for i in range(500)]
    mixed = np.array([xxhash.xxh64_intdigest(g.encode(), M.SEED) for g in grams], dtype=np.uint64) * M.MIX
    place = {int(h) | 1: i for i, h in enumerate(mixed)}
    least = [place[int(np.int64(p).view(np.uint64))] for p in M.sketch(M.shingle_hashes(" ".join(words), 5))[1]]
    other = list(words)
    for part, i in enumerate(least):
        if part not in but:
            other[i + 2] = f"{name}other{part}"
    return " ".join(words), " ".join(other), [grams[i] for i in least]


def test_pairs_that_agree_in_no_part_are_found(spark):
    rows = []
    for n in range(3):
        a, b, _ = apart_in_parts(f"w{n}x")
        x, y = (M.sketch(M.shingle_hashes(t, 5))[1] for t in (a, b))
        assert not [1 for p, q in zip(x, y) if p == q]
        rows += [(2 * n, a), (2 * n + 1, b)]
    got = {r["doc_id"]: r["component_id"] for r in M.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), max_bits=0).collect()}
    assert got == {i: i - i % 2 for i in range(6)}


def test_pairs_whose_one_common_part_is_large_are_found(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP_ROWS", 12)
    a, b, least = apart_in_parts("w", but=(3,))
    x, y = (M.sketch(M.shingle_hashes(t, 5))[1] for t in (a, b))
    assert [p for p in range(M.PARTS) if x[p] == y[p]] == [3]
    crowd = [t for t in (f"{least[3]} own{i} of{i} its{i} self{i}" for i in range(60)) if M.sketch(M.shingle_hashes(t, 5))[1][3] == x[3]]
    assert len(crowd) > 20
    rows = list(enumerate([a, b, *crowd]))
    got = {r["doc_id"]: r["component_id"] for r in M.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), max_bits=0).collect()}
    assert got == {i: 0 if i < 2 else i for i in range(len(rows))}


def test_ids_that_are_no_integers(spark):
    rows = [("b", "we walk in time"), ("a", "We walk\tin time"), ("c", "of another kind"), (None, "of another kind")]
    got = M.keep_one(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(tuple(r) for r in got) == [("a", "We walk\tin time"), ("c", "of another kind")]
