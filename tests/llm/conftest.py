import random

import pytest

#: Columns whose names clash with what the operators use inside.
CLASHING = "_digest string, _winner string, _lost_keys string, fp string, keys string, n_lines string, shard string, bucket string, x string, y string, score string, _row string, words string, key string, node string, root string, digest string, u string, unit string, licence string, term string, count string, at string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, one very long text, ties, repeated rows and clashing columns."""
    r = random.Random(5)
    line = "this very line is long enough to take part in line dedup"
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randint(0, 400)) for _ in range(30_000))
    texts = [None, "", " \n\t ", long, line, line.upper(), f"{line}\nown {1}", f"{line}\nown {2}", f" {line}\r\nown {3}", line, "a", "Ünï çödé \u2028 text", "<p>not html"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, line), (9, line), (None, "no id"), (None, None)]
    rest = [f"cast(null as string) as {c.split()[0]}" for c in CLASHING.split(", ")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "cast(null as string) as lang", "'s' as source", "cast(length(text) as bigint) as n_chars", *rest)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
