import corpus_pipeline as C
from chronoline.llm import quality_rules, registry

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert [name for name, _ in C.STAGES] == ["quality_classifier", "quality_rules", "line_dedup", "simhash_near_dedup", "packing"]
    for k, (name, stage) in enumerate(C.STAGES):
        columns = docs.columns
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        ids = {r["doc_id"] for r in rows}
        assert ids <= set(before)
        if k < 4:
            assert docs.columns == columns and len(rows) == len(ids)
        if name == "quality_classifier":
            assert not (clean - ids)
        if name == "quality_rules":
            judged = {r["doc_id"]: r["kept"] for r in quality_rules.judge_quality(spark.createDataFrame([(i, before[i]) for i in before], "doc_id bigint, text string")).collect()}
            assert ids == {i for i in kept_before if judged[i]}
        if name == "line_dedup":
            assert ids == kept_before
            for r in rows:
                lines = iter(before[r["doc_id"]].split("\n"))
                assert r["text"] == "" or all(line in lines for line in r["text"].split("\n"))
                assert r["n_chars"] == len(r["text"])
        if name == "simhash_near_dedup":
            texts = [r["text"] for r in rows]
            assert len(texts) == len(set(texts))
        if name == "packing":
            assert ids == kept_before
        kept_before = ids
    assert C.run(spark, SF).count() == len(ids)


def test_registry_names_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_odd_rows_pass_every_stage(spark, odd_docs, no_docs):
    """Nulls, empty and very long texts, repeated and missing ids, columns named like those used inside."""
    docs = odd_docs
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        assert out.count() <= docs.count()
        assert stage(spark, no_docs, SF).count() == 0, name
    assert C.STAGES[-1][1](spark, docs, SF).count() == docs.count() and C.STAGES[-1][1](spark, no_docs, SF).count() == 0


def test_near_copies_of_odd_rows_leave_one(spark, odd_docs):
    kept = C.dedup_documents(spark, odd_docs, SF).collect()
    texts = [" ".join((r["text"] or "").lower().split()) for r in kept]
    assert 5 < len(texts) == len(set(texts)) <= len({" ".join((r["text"] or "").lower().split()) for r in odd_docs.collect()})
