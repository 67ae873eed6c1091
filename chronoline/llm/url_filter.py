"""Operator 8: host and path rules, then a weighted URL vocabulary.

An Aho-Corasick automaton finds every strict and soft term of a URL in one
pass; a hit counts only where neither neighbour is a letter or a digit. One
strict term rejects the URL, and so do distinct soft terms whose weights add up to
``SOFT_NEEDED``; a plural counts with its singular, once. A rule that
fits takes precedence over the vocabulary. ``load_vocabulary`` reads a list of any size
from a file; the automaton is built once on the driver and broadcast.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no rule, and is judged by the vocabulary over what text there is (null: no
hits, so it is allowed). Repeated rows stay repeated; an empty table gives an
empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import ascii_lower

#: Terms that reject alone. Fixed values.
STRICT_TERMS = tuple(
    "bestiality bukkake cam4 camgirl camgirls casino casinos cialis creampie cumshot deepfake escort escorts fleshlight gangbang hentai hookup "
    "jackpot keygen levitra milf milfs nude nudes onlyfans payday porn porno pornos pornstar redtube roulette slotmachine sportsbook stripper "
    "tramadol viagra warez webcamsex xhamster xnxx xvideos xxx youporn".split()
)
#: Terms that reject together, with their weights. Fixed values.
SOFT_TERMS = {
    **dict.fromkeys(
        "adult affiliate bet betting bingo bonus cash cheap cheats clickbait coupon crack cracked credit crypto dating deal diet discount download free "
        "gamble gambling giveaway herbal hot kinky loan lottery lucky mature mortgage naked offer pharmacy pill poker popunder promo proxy "
        "refinance replica sale sex sexy singles slots spin stake teen torrent unblocked vape vip voyeur wager weightloss win winner".split(),
        1.0,
    ),
    **dict.fromkeys("blackjack fetish gambler lolita sexcam steroids".split(), 1.5),
    **dict.fromkeys("best buy click online shop top".split(), 0.5),
}
SOFT_NEEDED = 2.0


@dataclass(frozen=True)
class Vocabulary:
    """Strict terms, and soft terms with their weights; all lower-case letters, digits and inner marks."""

    strict: frozenset[str]
    soft: dict[str, float]

    def spellings(self) -> dict[str, tuple[str, float]]:
        """Each spelling with its term and weight, infinite for strict terms."""
        plurals = {term + "s": (term, weight) for term, weight in self.soft.items()}
        return plurals | {term: (term, weight) for term, weight in self.soft.items()} | {term: (term, float("inf")) for term in self.strict}


VOCABULARY = Vocabulary(frozenset(STRICT_TERMS), SOFT_TERMS)


def load_vocabulary(path: str) -> Vocabulary:
    """Lines of a term, and of a soft term its weight behind a tab; empty lines and lines from # on are left out."""
    strict, soft = set(), {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            term, _, weight = line.rstrip("\n").partition("\t")
            term = term.strip().lower()
            if not term or term.startswith("#"):
                continue
            if weight.strip():
                soft[term] = float(weight)
            else:
                strict.add(term)
    return Vocabulary(frozenset(strict), soft)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The host and path rules of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(after)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    own = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
    return own & F.startswith(path, F.lit(rule.path))


def longest_rule(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        here = fits(rule, host, path)
        text, verdict = F.when(here, F.lit(rule.text)).otherwise(text), F.when(here, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def build_automaton(vocabulary: Vocabulary) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for spelling, (term, weight) in vocabulary.spellings().items():
        automaton.add_word(spelling, (len(spelling), term, weight))
    automaton.make_automaton()
    return automaton


def hits(automaton: ahocorasick.Automaton, url: str | None) -> tuple[int, float]:
    """Number of distinct strict terms that stand alone in the URL, and weight of the distinct soft ones."""
    text = (url or "").lower()
    met: dict[str, float] = {}
    for end, (length, term, weight) in automaton.iter(text):
        begin = end - length + 1
        if (begin == 0 or not _alnum(text[begin - 1])) and (end + 1 == len(text) or not _alnum(text[end + 1])):
            met[term] = weight
    soft = [w for w in met.values() if w != float("inf")]
    return len(met) - len(soft), sum(soft)


def _alnum(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[Rule, ...] = RULES,
    vocabulary: Vocabulary = VOCABULARY,
    soft_needed: float = SOFT_NEEDED,
) -> DataFrame:
    """id, url, host, path, rule, verdict, strict_hits, soft_weight; one narrow map, no shuffle."""
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    shared = pages.sparkSession.sparkContext.broadcast(build_automaton(vocabulary))  # bounded by the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            found = [hits(automaton, url) for url in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([w for _, w in found], pa.float64())],
                names=["page_id", "url", "strict_hits", "soft_weight"],
            )

    kind = source.schema["page_id"].dataType.simpleString()
    counted = source.mapInArrow(count, f"page_id {kind}, url string, strict_hits bigint, soft_weight double")
    counted = counted.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    text, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    rejected = (F.col("strict_hits") >= 1) | (F.col("soft_weight") >= soft_needed)
    by_terms = F.when(rejected, F.lit("block")).otherwise(F.lit("allow"))
    return counted.select("page_id", "url", "host", "path", text.alias("rule"), F.coalesce(verdict, by_terms).alias("verdict"), "strict_hits", "soft_weight")


def oracle(rules: tuple[Rule, ...] = RULES, vocabulary: Vocabulary = VOCABULARY, soft_needed: float = SOFT_NEEDED) -> str:
    alone = r"regexp_matches(lower(coalesce(url, '')), '(^|[^a-z0-9]){}($|[^a-z0-9])')::bigint"
    strict = " + ".join(alone.format(t) for t in sorted(vocabulary.strict))
    spelt = lambda t: f"({t}|{t}s)" if t + "s" not in vocabulary.strict and t + "s" not in vocabulary.soft else t
    soft = " + ".join(f"{w} * {alone.format(spelt(t))}" for t, w in sorted(vocabulary.soft.items()) if t not in vocabulary.strict)
    fit = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    pick = lambda what: "case " + " ".join(f"when {fit(r)} then '{what(r)}'" for r in ordered) + " end"
    return f"""
with split as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path,
         {strict} as strict_hits, {soft} as soft_weight
  from pages)
select page_id, host, path, {pick(lambda r: r.text)} as rule,
       coalesce({pick(lambda r: r.verdict)}, case when strict_hits >= 1 or soft_weight >= {soft_needed} then 'block' else 'allow' end) as verdict
from split"""
