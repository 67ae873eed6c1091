import itertools
import random
from collections import defaultdict

from chronoline.llm import packing as P


def brute(lengths, k):
    distinct = sorted(set(lengths))
    best = None
    for n in range(1, min(k, len(distinct)) + 1):
        for cut in itertools.combinations(distinct[:-1], n - 1):
            edges = [*cut, distinct[-1]]
            pad = sum(next(e for e in edges if e >= x) - x for x in lengths)
            best = pad if best is None else min(best, pad)
    return best


def test_boundaries_have_least_padding():
    r = random.Random(3)
    for _ in range(30):
        lengths = [r.randint(0, 12) for _ in range(r.randint(1, 25))]
        values = sorted(set(lengths))
        counts = [lengths.count(v) for v in values]
        plan = P.choose_boundaries(counts, values, 3)
        assert plan.padding == brute(lengths, 3)
        assert sum(plan.counts) == len(lengths) and plan.boundaries[-1] == max(lengths)


def slow_boundaries(counts, values, k):
    """The textbook programme over every cut, with no use of order."""
    n = len(values)
    pad = lambda i, j: sum(c * (values[j - 1] - v) for c, v in zip(counts[i:j], values[i:j]))
    best = [0] + [pad(0, j) for j in range(1, n + 1)]
    least = best[n]
    for _ in range(k - 1):
        best = [0] + [min(best[i] + pad(i, j) for i in range(j)) for j in range(1, n + 1)]
        least = min(least, best[n])
    return least


def test_halving_equals_the_textbook_programme():
    r = random.Random(4)
    for n, k in [(1, 4), (2, 4), (7, 3), (40, 5), (60, 8), (61, 2)]:
        values = sorted(r.sample(range(200_000), n))
        counts = [r.choice([1, 2, 900]) for _ in values]
        plan = P.choose_boundaries(counts, values, k)
        assert plan.padding == slow_boundaries(counts, values, k)
        edges = plan.boundaries
        assert sum(c * (next(e for e in edges if e >= v) - v) for c, v in zip(counts, values)) == plan.padding and len(edges) <= k


def test_boundaries_of_the_documents_are_optimal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lengths = sorted(len((x["text"] or "").split()) for x in docs.collect())
    values = sorted(set(lengths))
    plan = P.plan_buckets(P.token_lengths(docs), 6)
    assert max(values) > 256 and plan.padding == slow_boundaries([lengths.count(v) for v in values], values, 6)


def test_rows_of_one_id_are_dealt_to_many_shards(spark):
    rows = spark.range(3000).selectExpr("cast(if(id % 2 = 0, null, 7) as bigint) as doc_id", "10L as n_tokens")
    out = P.pack_lengths(rows, budget=40, shard_rows=100)
    shards = out.groupBy("doc_id", ((P.F.col("batch_id") / (1 << 20)).cast("long") % (1 << 28)).alias("shard")).count()
    assert shards.groupBy("doc_id").max("count").agg({"max(count)": "max"}).first()[0] < 150
    assert out.count() == 3000


def test_batches_hold_the_budget_and_every_row(spark):
    r = random.Random(9)
    rows = [(i, max(0, int(r.gauss(120, 80)))) for i in range(3000)] + [(5000, 9000)]
    out = P.pack_lengths(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), n_buckets=6, budget=4096, shard_rows=256).collect()
    assert sorted((o["doc_id"], o["n_tokens"]) for o in out) == sorted(rows)
    batches = defaultdict(list)
    for o in out:
        assert o["n_tokens"] + o["padding"] == o["boundary"] and o["padding"] >= 0
        batches[o["batch_id"]].append(o)
    for own in batches.values():
        assert len({o["boundary"] for o in own}) == 1
        assert len(own) == 1 or len(own) * own[0]["boundary"] <= 4096
        assert sorted(o["position"] for o in own) == list(range(len(own)))


def test_odd_rows(odd_docs, no_docs):
    assert P.pack_documents(odd_docs).count() == odd_docs.count()
    assert P.pack_documents(no_docs).count() == 0
