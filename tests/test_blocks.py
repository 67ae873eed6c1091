import difflib
import random
import time

import pytest
from chronoline.operators import alignment as A
from chronoline.operators import blocks as B


@pytest.mark.parametrize("few", [0, B.FEW_PAIRS])
def test_opcodes_equal_the_standard_library(monkeypatch, few):
    monkeypatch.setattr(B, "FEW_PAIRS", few)
    r = random.Random(few)
    for _ in range(300):
        k = r.choice([2, 3, 10])
        a = [r.randrange(k) for _ in range(r.randint(0, 40))]
        b = [x for x in a if r.random() < 0.8] if r.random() < 0.5 else [r.randrange(k) for _ in range(r.randint(0, 40))]
        b = b * r.choice([1, 1, 2])
        assert B.opcodes(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes(), (a, b)


def test_repeats_do_not_multiply_the_work():
    """Two texts of a few words that repeat for ever; every pair of equal words would be 10**9 steps."""
    r = random.Random(1)
    a = [r.choice("abc") for _ in range(30_000)]
    b = list(a)
    for _ in range(300):
        b[r.randrange(len(b))] = "z"
    began = time.perf_counter()
    found = B.opcodes(a, b)
    assert time.perf_counter() - began < 20
    assert sum(i1 - i0 for tag, i0, i1, _, _ in found if tag == "equal") > 29_000


def test_shared_tokens_are_dealt_by_parts(spark):
    words = spark.createDataFrame([("s", i, t, i * 0.5, i * 0.5 + 0.4) for i, t in enumerate("come ma ma ma ma on".split())], "s string, pos long, text string, start double, end double")
    tokens = spark.createDataFrame([("s", 0, "come", "come", 0, ["come"]), ("s", 1, "magic", "magic", 1, ["mag", "ic"]), ("s", 2, "on", "on", 1, ["on"])], "s string, pos long, norm string, original string, line_no long, parts array<string>")
    rows = A.align_to_reference(words, tokens, "s").orderBy("pos").collect()
    assert [r["new_text"] for r in rows] == ["come", "ma", "ma", "ma", "ma", "on"]
    assert [r["reference_text"] for r in rows] == ["come", "mag", "ic", "mag", "ic", "on"]
    plain = A.align_to_reference(words, tokens.drop("parts"), "s").orderBy("pos").collect()
    assert [r["reference_text"] for r in plain] == ["come", "magic", "magic", "magic", "magic", "on"]
