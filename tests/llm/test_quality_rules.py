import re
from collections import Counter

from chronoline.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark, odd_docs):
    texts = ["a b c a b c a b c", "x y z w x y z", "one\none\n\n two \none\n two ", "a # $ <b>", "a b", "aa " * 500, "é è é è é", "a b c d a b c e b c d"]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(r["doc_id"], r["text"]) for r in odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    got = {r["doc_id"]: r for r in Q.judge_quality(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for doc_id, text in rows:
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(text)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_plan_is_native_and_rows_stay(odd_docs, no_docs):
    plan = Q.judge_quality(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert Q.judge_quality(odd_docs).count() == odd_docs.count()
    assert Q.judge_quality(no_docs).count() == 0


def test_keep_documents_keeps_clean_prose_and_all_columns(spark):
    clean = " ".join(f"the word{i} of and to place{i}" for i in range(40))
    rows = [(1, clean, "x"), (2, " ".join(f"w{i}%%%" for i in range(200)), "x"), (3, "too short", "x"), (4, None, None)]
    out = Q.keep_documents(spark.createDataFrame(rows, "doc_id bigint, text string, kept string"))
    assert [(r["doc_id"], r["text"], r["kept"]) for r in out.collect()] == [(1, clean, "x")]
