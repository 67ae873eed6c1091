import zlib

import numpy as np
from chronoline.llm import quality_classifier as Q


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = Q.score_documents(docs, labels)
    rows = out.join(labels, "doc_id").collect()
    assert out.count() == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(r["predicted"] == 1 for r in held if r["quality"] == 1)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_labels_of_held_out_documents_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    held = Q.fold_is_held_out(Q.F.col("doc_id"))
    flipped = labels.withColumn("quality", Q.F.when(held, 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    scores = [{r["doc_id"]: round(r["score"], 9) for r in Q.score_documents(docs, x).collect()} for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = Q.score_documents(odd_docs, none).collect()
    assert len(out) == odd_docs.count() and {r["score"] for r in out} == {0.5}
    some = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (10, 0, 0), (11, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert Q.score_documents(odd_docs, some).count() == odd_docs.count()
    assert Q.score_documents(no_docs, some).count() == 0
    assert Q.keep_documents(odd_docs, none).columns == odd_docs.columns


def test_sums_equal_the_risk_and_its_derivatives():
    r = np.random.default_rng(2)
    x, positive, w = r.standard_normal((40, 5)), r.random(40) < 0.3, r.standard_normal(5) / 3
    loss = lambda w: sum(np.log1p(np.exp(xi @ w)) for xi in x)
    own = lambda w, sign: sum(np.log1p(np.exp(sign * (xi @ w))) for xi, p in zip(x, positive) if p)
    d, step = 5, 1e-5
    slope = lambda f, w: np.array([(f(w + step * e) - f(w - step * e)) / (2 * step) for e in np.eye(d)])
    t = Q.part_sums(x, positive, w)
    assert np.allclose(t[:d], slope(loss, w), atol=1e-5) and np.allclose(t[d + d * d : 2 * d + d * d], slope(lambda v: own(v, 1), w), atol=1e-5)
    curve = np.array([slope(lambda v, i=i: slope(loss, v)[i], w) for i in range(d)])
    assert np.allclose(t[d : d + d * d].reshape(d, d), curve, atol=1e-3)
    assert np.allclose(t[-3:], [loss(w), own(w, -1), own(w, 1)])


def test_prior_from_positives_and_unlabelled(spark):
    r = np.random.default_rng(4)
    for prior in (0.3, 0.6, 0.85):
        u = np.concatenate([r.normal(2, 1, int(20_000 * prior)), r.normal(-3, 1, int(20_000 * (1 - prior)))])
        p = r.normal(2, 1, 4000)
        edges = np.linspace(-8, 8, 257)
        assert abs(Q.tail_bound(np.histogram(u, edges)[0].astype(float), np.histogram(p, edges)[0].astype(float)) - prior) < 0.05


def test_labels_of_bad_documents_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    scores = [{r["doc_id"]: round(r["score"], 9) for r in Q.score_documents(docs, x).collect()} for x in (labels, labels.where("quality = 1"))]
    assert scores[0] == scores[1]


def test_the_ridge_is_chosen_without_held_out_rows(spark, monkeypatch):
    """Neither texts nor labels of held-out documents reach the choice."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    seen = []
    keep = Q.choose_ridge
    monkeypatch.setattr(Q, "choose_ridge", lambda x, positive, part, prior: (seen.append((x.shape, x.sum(), positive.sum())), keep(x, positive, part, prior))[1])
    held = Q.fold_is_held_out(Q.F.col("doc_id"))
    Q.fit(Q.training_table(docs, labels))
    Q.fit(Q.training_table(docs.withColumn("text", Q.F.when(held, Q.F.lit("#### || !!")).otherwise(Q.F.col("text"))), labels))
    Q.fit(Q.training_table(docs, labels.where(~held)))
    assert seen[0] == seen[1] == seen[2] and seen[0][0][0] == docs.where(~held).count()


def test_the_fit_has_least_risk_and_a_ridge_suits_its_rows():
    r = np.random.default_rng(6)
    n = 600
    good = r.random(n) < 0.6
    x = np.c_[np.ones(n), r.standard_normal((n, 3)) + 1.5 * good[:, None]]
    positive = good & (r.random(n) < 0.5)
    sums, mean_p = Q.array_sums(x, positive), x[positive].mean(axis=0)
    w = Q.minimise(sums, n, int(positive.sum()), mean_p, 0.6, 1e-2)

    def risk(w):
        t = sums(w)
        ridges = np.array([1e-3, 1e-2, 1e-2, 1e-2])
        return 0.6 * t.p_pos / positive.sum() + max(0.0, t.u_neg / n - 0.6 * t.p_neg / positive.sum()) + 0.5 * ridges @ (w * w)

    assert all(risk(w + step * e) >= risk(w) - 1e-6 for e in np.eye(4) for step in (-0.05, 0.05))
    assert np.mean((x @ w > 0) == good) > 0.9
    part = np.arange(n) % 4
    assert Q.choose_ridge(x, positive, part, 0.6) in Q.RIDGES
    assert Q.choose_ridge(x, np.zeros(n, bool), part, 0.6) == max(Q.RIDGES)
