"""Operator 11: chi-square divergence of the sources of a language by joint count histograms.

1. Each task counts the terms of its documents by language, source and term (``term_counts``), so that a frequent term is one row a
   task and source; the sums of these rows are written once.
2. A term stays if enough documents of its language hold it. Sources are numbered within their language.
3. For two sources f depends on a term only through its two counts. Shards of terms, cut by hash, tally the distinct pairs of positive
   counts of any two sources (``_tally``); sums over shards give the joint histogram of a pair. Cells with a zero are implied: terms with count a
   in one source and none in the other are those of the source's own histogram less the pair's cells of count a, and
   what then lacks to V holds neither. f is evaluated once a cell and multiplied by the cell's size.
4. More sources than ``SOURCE_BLOCK`` meet in blocks of sources, two blocks a group, so a group holds at most so many counts a term.

All arithmetic is on integers: sums and f in long, products in decimal(38, 0).

Defined cases: null text, lang and source are ''; texts without a term only bring their group into being; a row is a document, so repeated rows
count each, whatever their ids; with no kept term a pair's value is 0; other columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline.llm.common import broadcast_keys, checkpoint

#: Fixed value: a term is a stretch of ASCII letters and characters beyond ASCII; in UTF-8 these are the bytes from 0x80.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
TERMS_AT_ONCE = 600_000
#: A task holds a term's count and its documents in one integer, the documents in so many low bits.
DOCS_BITS = 30
SHARD_ROWS = 400_000
SOURCE_BLOCK = 64


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: partial sums of each task; a term of null brings a group without terms."""

    def emit(held: dict[tuple[str, str], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in held.items():
            both = np.array([0, *own.values()], dtype=np.int64)
            terms = pa.array([None, *own], pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * len(both)), pa.array([source] * len(both)), terms, pa.array(both >> DOCS_BITS), pa.array(both & ((1 << DOCS_BITS) - 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "count", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = docs_ = 0
        for batch in batches:
            for lang, source, text in zip(*batch.columns):
                own = held.setdefault((lang.as_py(), source.as_py()), {})
                before, had = len(own), own.get
                for term, n in Counter(TERM.findall(text.as_py().encode().lower())).items():  # bytes: A-Z only
                    own[term] = had(term, 0) + (n << DOCS_BITS) + 1
                size += len(own) - before
                docs_ += 1
                if size > TERMS_AT_ONCE or docs_ >> (DOCS_BITS - 1):
                    yield from emit(held)
                    held, size, docs_ = {}, 0, 0
        yield from emit(held)

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*text).mapInArrow(run, "lang string, source string, term string, count bigint, docs bigint")


def _tally(table: pa.Table, block: int) -> pa.Table:
    """Counts of one shard of terms for two blocks of sources -> distinct pairs of positive counts (ca, cb) of every two sources a < b, and their number."""
    lang, low, high = (table.column(c)[0].as_py() for c in ("lang", "low", "high"))
    _, term = np.unique(table.column("term").to_numpy(zero_copy_only=False), return_inverse=True)
    source, count = table.column("source").to_numpy(), table.column("count").to_numpy()
    values, code = np.unique(count, return_inverse=True)
    at = {s: np.flatnonzero(source == s) for s in np.unique(source).tolist()}
    column = np.full(int(term.max()) + 1, -1, dtype=np.int64)
    found = {c: [] for c in ("a", "b", "ca", "cb", "n")}
    for a in (s for s in at if s // block == low):
        column[term[at[a]]] = code[at[a]]
        for b in (s for s in at if s // block == high and s > a):
            mine = column[term[at[b]]]
            both = mine >= 0
            cell, n = np.unique(mine[both] * len(values) + code[at[b]][both], return_counts=True)
            for c, v in (("a", np.full(len(n), a)), ("b", np.full(len(n), b)), ("ca", values[cell // len(values)]), ("cb", values[cell % len(values)]), ("n", n)):
                found[c].append(v)
        column[term[at[a]]] = -1
    out = {c: pa.array(np.concatenate([np.empty(0, np.int64), *v]).astype(np.int64)) for c, v in found.items()}
    return pa.table({"lang": pa.array([lang] * len(out["n"]), pa.string()), **out})


def _share(count: str, total: str) -> str:
    """p of a count by the contract; total is N + V, null where a language keeps no term."""
    return f"(1 + (cast({SCALE} as decimal(19,0)) * cast({count} + 1 as decimal(19,0))) div {total})"


def _distance(p: str, q: str) -> str:
    return f"((cast({p} - {q} as decimal(19,0)) * cast({p} - {q} as decimal(19,0))) div {q})"


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, count, in_lang, first: counts of the kept terms, their sum in the language and a mark on one row of each term; a row of a null term for every group."""
    partly = term_counts(docs).repartition("lang", "term")  # the sums and the windows behind all keep this layout
    counts = partly.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    summed = counts.select("*", F.sum("docs").over(of_term).alias("held"), F.sum("count").over(of_term).alias("in_lang"), (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"))
    return checkpoint(summed.where((F.col("held") >= min_docs) | F.col("term").isNull()).select("lang", "source", "term", "count", "in_lang", "first"))


def source_totals(counts: DataFrame) -> DataFrame:
    """lang, source, at (number in the language), terms, total (N + V), lang_total, v, of (sources of the language)."""
    own = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("term").alias("terms"))
    langs = counts.groupBy("lang").agg(F.sum("count").alias("lang_n"), F.count(F.when(F.col("first") & F.col("term").isNotNull(), 1)).alias("v"), F.count("term").alias("rows"))
    numbered = own.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    of = F.count("*").over(Window.partitionBy("lang")).alias("of")
    return checkpoint(numbered.join(langs, "lang").select("lang", "source", "at", "terms", "rows", F.expr("nullif(n + v, 0)").alias("total"), F.expr("nullif(lang_n + v, 0)").alias("lang_total"), "v", of))


def joint_cells(counts: DataFrame, sources: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """lang, a, b, ca, cb, n: how many kept terms have the counts (ca, cb) in the sources numbered a < b; cells with a zero included, cells of none left out."""
    numbers = broadcast_keys(sources.select("lang", "source", "at", "rows", "of"))
    rows = counts.where("term is not null").join(numbers, ["lang", "source"])
    size = SOURCE_BLOCK
    block = F.expr(f"at div {size}")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(of - 1) div {size}"))).alias("other")
    shard = F.pmod(F.xxhash64("term"), F.ceil(F.col("rows") / (shard_rows or SHARD_ROWS))).alias("shard")
    dealt = rows.select("lang", "term", F.col("at").alias("source"), "count", block.alias("block"), shard, other)
    dealt = dealt.select("lang", "term", "source", "count", "shard", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    kinds = "lang string, a bigint, b bigint, ca bigint, cb bigint, n bigint"
    met = checkpoint(dealt.groupBy("lang", "low", "high", "shard").applyInArrow(lambda t: _tally(t, size), kinds).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("n").alias("n")))

    none = F.lit(0).cast("long")
    cell = lambda ca, cb, n: ("lang", "a", "b", ca.alias("ca"), cb.alias("cb"), n.alias("n"))
    own = rows.groupBy("lang", "at", "count").agg(F.count("*").alias("n"))
    left, right = sources.select("lang", F.col("at").alias("a"), F.col("terms").alias("in_a"), "v"), sources.select("lang", F.col("at").alias("b"), F.col("terms").alias("in_b"))
    pairs = left.join(right, "lang").where("a < b")
    ca, cb, n = F.col("ca"), F.col("cb"), F.col("n")
    parts = [
        met.select(*cell(ca, cb, n)), met.select(*cell(ca, none, -n)), met.select(*cell(none, cb, -n)), met.select(*cell(none, none, n)),
        pairs.select(*cell(none, none, F.expr("v - in_a - in_b"))),
        pairs.join(own.withColumnRenamed("at", "a"), ["lang", "a"]).select(*cell(F.col("count"), none, n)),
        pairs.join(own.withColumnRenamed("at", "b"), ["lang", "b"]).select(*cell(none, F.col("count"), n)),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("n").alias("n")).where("n <> 0")


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: divergence from each other source (part pair) and the terms a source stands out by (part term, ranks to top)."""
    counts = kept_counts(docs, min_docs)
    sources = source_totals(counts)
    held = broadcast_keys(sources)

    side = lambda at: held.select("lang", F.col("at").alias(at), F.col("total").alias(f"total_{at}"), F.col("source").alias(f"source_{at}"))
    cells = joint_cells(counts, sources).join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
    shares = cells.select("lang", "source_a", "source_b", "n", F.expr(_share("ca", "total_a")).alias("pa"), F.expr(_share("cb", "total_b")).alias("pb"))
    summed = shares.groupBy("lang", "source_a", "source_b").agg(F.expr(f"sum(n * {_distance('pa', 'pb')})").alias("ab"), F.expr(f"sum(n * {_distance('pb', 'pa')})").alias("ba"))
    way = lambda group, item, value: F.struct(F.col(group).alias("source"), F.col(item).alias("item"), F.col(value).alias("value"))
    both = F.explode(F.array(way("source_a", "source_b", "ab"), way("source_b", "source_a", "ba"))).alias("p")
    found = summed.select("lang", both).select("lang", "p.*")
    pairs = sources.select("lang", "source").join(sources.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(found, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    shared = counts.where("count > 0").join(held.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    shared = shared.select("lang", "source", "term", F.expr(_share("count", "total")).alias("p"), F.expr(_share("in_lang", "lang_total")).alias("q")).where("p > q")
    terms = shared.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_distance("p", "q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).union(ranked(terms).where(F.col("rank") <= top))


def oracle(min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> str:
    return rf"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
word as (select r, lang, source, unnest(w) as term from docs),
kept as (select lang, term, count(*) as c from word group by all having count(distinct r) >= {min_docs}),
v as (select d.lang, count(k.term) as v, coalesce(sum(k.c), 0) as n from (select distinct lang from docs) d left join kept k using (lang) group by d.lang),
own as (select lang, source, term, count(*) as c from word semi join kept using (lang, term) group by all),
grp as (select g.lang, g.source, coalesce(sum(c), 0) as n from (select distinct lang, source from docs) g left join own using (lang, source) group by all),
p as (
  select g.lang, g.source, k.term, coalesce(o.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(o.c, 0) + 1)) // (g.n + v.v)::hugeint as p,
         1 + (1000000000::hugeint * (k.c + 1)) // (v.n + v.v)::hugeint as q
  from grp g join v using (lang) join kept k using (lang) left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
pair as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
part as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
  left join pair x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all
  select lang, source, 'term', term, (((p - q) * (p - q)) // q)::bigint from p where c > 0 and p > q)
select lang, source, part, item, value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from part)
where part = 'pair' or rank <= {top}"""
