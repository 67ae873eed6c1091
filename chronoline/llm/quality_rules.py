"""Operator 3 [native]: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the whole text: no user function,
no shuffle, no explode. Repeated word windows are found inside the row: windows
become (hash, position) pairs, sorted once, and equal neighbours name the
repeated positions; their 3-word spans are then merged by position, so the work is
n log n in the words of a text.

Defined cases: null and empty texts have no words and no lines, every count is 0,
and they fail the base rule; other columns may be null or have any name
(only the id and the text are read); repeated rows are judged one by one; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import SPACE_CLASS, SPACES, WORD_CLASS, words_of

#: Frequent function words of the corpus' languages, looked up in lower case.
STOP_WORDS = (
    "the of and to in is it that for on as with was at by be this from or are a an "
    "de la le les et des un une en que qui du est pour dans par sur pas au avec "
    "der die das und den von zu mit sich dem nicht ist im für auf ein eine als auch "
    "el los las del se con por para y o su lo no"
).split()
WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """Keep while low <= measure <= high; a None bound is open."""

    measure: str
    low: float | None = None
    high: float | None = None


THRESHOLDS = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbols_per_word", None, 0.3),
    Rule("stop_word_ratio", 0.04, None),
    Rule("dup_line_ratio", None, 0.6),
    Rule("shout_ratio", None, 0.3),
)


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each step is one projection, so that no array is computed twice; _row carries the whole row, and is pruned where unused."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    df = df.select(
        "_row", "doc_id", words_of(F.col("text")).alias("words"), lines.alias("lines"),
        F.length(F.regexp_replace("text", SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^!]+", "")).cast("long").alias("n_shouts"),
    )
    n = F.size("words")
    following = lambda i, k: F.get("words", i + k)
    windows = F.transform(
        F.slice("words", 1, F.greatest(n - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, *(following(i, k) for k in range(1, WINDOW))).alias("h"), i.alias("i")),
    )
    df = df.select(
        "_row", "doc_id", n.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_shouts",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.sort_array(windows).alias("windows"),
    )
    beside = lambda i, k: F.get("windows", i + k)["h"]
    repeated = F.filter("windows", lambda w, i: F.coalesce(w["h"] == beside(i, -1), F.lit(False)) | F.coalesce(w["h"] == beside(i, 1), F.lit(False)))
    df = df.withColumn("at", F.sort_array(F.transform(repeated, lambda w: w["i"]))).drop("windows")
    spans = F.transform("at", lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get("at", k + 1) - p), F.lit(WINDOW)))
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", covered).drop("at")


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, and the ratios that the threshold table names."""
    return _measured(docs, id_col, text_col).withColumns(
        {
            "mean_word_chars": _ratio("word_chars", "n_words"),
            "symbols_per_word": _ratio("n_symbols", "n_words"),
            "stop_word_ratio": _ratio("n_stop_words", "n_words"),
            "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
            "shout_ratio": _ratio("n_shouts", "n_words"),
        }
    )


def compile_rules(rules: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """One boolean column: every rule of the table holds."""
    tests = []
    for rule in rules:
        if rule.low is not None:
            tests.append(F.col(rule.measure) >= rule.low)
        if rule.high is not None:
            tests.append(F.col(rule.measure) <= rule.high)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, the ratios, base_failed and kept."""
    df = measures(docs, id_col, text_col)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def keep_documents(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    The filter reads a row id, which holds it above the projections: pushed under them it would repeat each one.
    """
    judged = judge_quality(docs, rules).select("_row", "kept", F.monotonically_increasing_id().alias("_at"))
    return judged.where(F.col("kept") & (F.col("_at") >= 0)).select("_row.*")


def oracle(rules: tuple[Rule, ...] = THRESHOLDS) -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    ratio = lambda a, b: f"(case when {b} > 0 then {a}::double / {b} else 0.0 end)"
    exprs = {
        "mean_word_chars": ratio("word_chars", "n_words"), "symbols_per_word": ratio("n_symbols", "n_words"),
        "stop_word_ratio": ratio("n_stop", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "shout_ratio": ratio("n_shouts", "n_words"),
    }
    tests = [f"{exprs[r.measure]} >= {r.low}" for r in rules if r.low is not None] + [f"{exprs[r.measure]} <= {r.high}" for r in rules if r.high is not None]
    return rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '{WORD_CLASS}+') as words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD_CLASS}')) as lines from t),
win as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g
        from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
cov as (select doc_id, count(distinct p)::bigint as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep) group by doc_id),
m as (select w.doc_id, len(words)::bigint as n_words,
             length(regexp_replace(text, '{SPACE_CLASS}', '', 'g'))::bigint as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             length(regexp_replace(text, '[^!]', '', 'g'))::bigint as n_shouts,
             len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
             len(list_filter(words, lambda x: lower(x) in ({stop})))::bigint as n_stop,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from w left join cov on w.doc_id = cov.doc_id),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {' and '.join(tests)} as kept
from b"""
