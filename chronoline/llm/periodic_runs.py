"""Operator 12: periodic runs of words by partition refinement.

Positions of a text fall into classes of equal factors of length 1, 2, 3, ... A class is refined to the next length by
the classes of the positions behind it, and of the parts a class fell into, all but the largest are used to refine
(``Classes.refine``): a position is moved once for each halving of its class, n log n moves in all. Classes keep their
members linked in order of position. Two neighbours of a class of length q that are q apart are a square whose root is no power, and
squares at consecutive positions merge into one run of smallest period q (``find_runs``).

Many texts are refined together: a word is told apart by its text, and a separator of its own closes each text, so no
factor crosses it. Each level is a few numpy calls over the moved positions. A word that occurs in its text fewer times
than the least exponent is in no run and stands alone from the start; a text is left once the length
passes its longest possible period.

Texts are independent rows: Spark deals them, there is no shuffle, and memory follows ``WORDS_AT_ONCE`` or one text, if that is longer.

Defined cases: null and empty texts have no words and no run and collapse to an empty text; a null doc_id is kept as it is;
repeated rows are answered one by one; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import words_of

MIN_EXPONENT = 4
MIN_WORDS = 6
WORDS_AT_ONCE = 400_000
RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Classes:
    """Equal-factor classes of positions. The members of class c are order[start[c] : start[c] + size[c]], in any order; before and after link them by position."""

    def __init__(self, first: np.ndarray, text: np.ndarray, longest: np.ndarray):
        """first: class of each position at length 1, numbered from 0; text: whose it is; longest: longest period of interest there."""
        n = len(first)
        self.text, self.longest, self.of = text, longest, first.copy()
        self.order = np.argsort(first, kind="stable")
        self.at = np.empty(n, dtype=np.int64)
        self.at[self.order] = np.arange(n)
        self.size, self.start = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        self.used = int(first.max()) + 1 if n else 0
        self.size[: self.used] = np.bincount(first, minlength=self.used)
        self.start[1 : self.used] = np.cumsum(self.size[: self.used])[:-1]
        self.before, self.after = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        same = np.flatnonzero(first[self.order[1:]] == first[self.order[:-1]])
        self.after[self.order[same]], self.before[self.order[same + 1]] = self.order[same + 1], self.order[same]
        self.moving = np.zeros(n, dtype=bool)
        self.waiting: dict[int, list[np.ndarray]] = defaultdict(list)
        self._await(self.order[same], 1)
        # every class but the largest of its text refines the next length
        largest = np.zeros(int(text.max()) + 1 if n else 0, dtype=np.int64)
        own = text[self.order[self.start[: self.used]]] if n else text
        by_size = np.argsort(self.size[: self.used], kind="stable")
        largest[own[by_size]] = by_size
        self.small = np.flatnonzero(largest[text] != first)

    def _await(self, left: np.ndarray, length: int) -> None:
        """Files neighbours (by the left one) under their distance, at which they may be a square."""
        gap = self.after[left] - left
        due = (gap >= length) & (gap <= self.longest[left])
        left, gap = left[due], gap[due]
        if len(left):
            by_gap = np.argsort(gap, kind="stable")
            left, gap = left[by_gap], gap[by_gap]
            cuts = np.flatnonzero(np.diff(gap)) + 1
            for d, part in zip(gap[np.r_[0, cuts]].tolist(), np.split(left, cuts)):
                self.waiting[d].append(part)

    def squares(self, length: int) -> np.ndarray:
        """Ascending starts of the squares whose root has this length, which must be the length of the classes."""
        found = self.waiting.pop(length, None)
        if found is None:
            return np.empty(0, dtype=np.int64)
        left = np.concatenate(found)
        return np.sort(left[self.after[left] - left == length])

    def refine(self, length: int) -> bool:
        """From classes of factors one shorter to classes of this length; False once nothing can change any more."""
        i = np.sort(self.small) - 1
        i = i[i >= 0]
        i = i[(self.size[self.of[i]] > 1) & (self.longest[i] >= length)]
        self.small = np.empty(0, dtype=np.int64)
        if not len(i):
            return False
        pair = self.of[i] * (len(self.of) + 1) + self.of[i + 1]
        i = i[np.argsort(pair, kind="stable")]
        home, behind = self.of[i], self.of[i + 1]
        new_class = np.r_[True, home[1:] != home[:-1]]
        new_part = new_class | np.r_[True, behind[1:] != behind[:-1]]
        heads = np.flatnonzero(new_part)
        count = np.diff(np.r_[heads, len(i)])
        part_home = home[heads]
        class_heads = np.flatnonzero(new_class[heads])  # per class touched: its first part
        parts = np.diff(np.r_[class_heads, len(heads)])
        touched, most = np.add.reduceat(count, class_heads), np.maximum.reduceat(count, class_heads)
        rest = self.size[part_home[class_heads]] - touched
        is_most = count == np.repeat(most, parts)
        upto = np.cumsum(is_most)
        largest = is_most & (upto == np.repeat(upto[class_heads] - is_most[class_heads] + 1, parts))  # the first of the largest
        stays = largest & np.repeat(rest == 0, parts)
        helps = ~(largest & np.repeat(rest < most, parts))
        moved = np.repeat(~stays, count)
        gone = i[moved]
        if len(gone):
            self._move(gone, home[moved], count[~stays], length)
        left_over = part_home[class_heads][(rest > 0) & (rest < most)]
        small = [i[np.repeat(helps & ~stays, count)]]
        if len(left_over):
            n = self.size[left_over]
            small.append(self.order[np.repeat(self.start[left_over] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        self.small = np.concatenate(small)
        return True

    def _move(self, gone: np.ndarray, home: np.ndarray, count: np.ndarray, length: int) -> None:
        """Makes new classes of the parts: gone is in order of class, part and position, count the size of each part."""
        self.moving[gone] = True
        # close the gaps that chains of leaving members make
        by_place = gone[np.lexsort((gone, home))]
        before, after = self.before[by_place], self.after[by_place]
        left = before[(before < 0) | ~self.moving[before]]
        right = after[(after < 0) | ~self.moving[after]]
        has_left, has_right = left >= 0, right >= 0
        self.after[left[has_left]], self.before[right[has_right]] = right[has_left], left[has_right]
        changed = [left[has_left & has_right]]
        # link the members of each new class
        ends = np.cumsum(count) - 1
        old = self.after[gone]
        new = np.r_[gone[1:], -1]
        new[ends] = -1
        self.after[gone] = new
        new_before = np.r_[-1, gone[:-1]]
        new_before[np.r_[0, ends[:-1] + 1]] = -1
        self.before[gone] = new_before
        changed.append(gone[(new >= 0) & (new != old)])
        # the last places of a class go to its leaving members; members that stay swap out of them
        first = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
        leave, own = np.diff(np.r_[first, len(home)]), home[first]
        tail = self.start[own] + self.size[own] - leave
        places = np.repeat(tail - first, leave) + np.arange(len(gone))
        there = self.order[places]
        stay = there[~self.moving[there]]
        free = self.at[gone[self.at[gone] < np.repeat(tail, leave)]]
        self.order[free], self.at[stay] = stay, free
        self.order[places], self.at[gone] = gone, places
        self.size[own] -= leave
        ids = np.arange(self.used, self.used + len(count))
        self.used += len(count)
        self.start[ids], self.size[ids] = places[np.r_[0, ends[:-1] + 1]], count
        self.of[gone] = np.repeat(ids, count)
        self.moving[gone] = False
        self._await(np.concatenate(changed), length)


def find_runs(words: np.ndarray, lengths: np.ndarray, min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS) -> np.ndarray:
    """words: numbers of the words of several texts in a row, lengths: how many each has -> rows (text, start, length, period), in that order."""
    n_texts = len(lengths)
    text = np.repeat(np.arange(n_texts), lengths + 1)  # one place more for the separator
    begin = np.cumsum(lengths + 1) - lengths - 1
    is_word = np.ones(len(text), dtype=bool)
    is_word[begin + lengths] = False
    top = int(words.max()) + 1 if len(words) else 1
    code = np.full(len(text), -1, dtype=np.int64)
    code[is_word] = text[is_word] * top + words
    _, number, times = np.unique(code, return_inverse=True, return_counts=True)
    alone = (times[number] < max(2, min_exponent)) | ~is_word
    first = np.empty(len(text), dtype=np.int64)
    shared, renumbered = np.unique(number[~alone], return_inverse=True)
    first[~alone] = renumbered
    first[alone] = len(shared) + np.arange(alone.sum())
    longest = (lengths // min_exponent)[text]
    classes = Classes(first, text, longest)
    found = []
    for length in range(1, int(longest.max(initial=0)) + 1):
        if length > 1 and not classes.refine(length) and not classes.waiting:
            break
        at = classes.squares(length)
        if len(at):
            heads = np.flatnonzero(np.r_[True, np.diff(at) > 1])
            size = at[np.r_[heads[1:] - 1, len(at) - 1]] - at[heads] + 2 * length
            long = size >= max(min_words, min_exponent * length)
            start = at[heads][long]
            found.append(np.stack([text[start], start - begin[text[start]], size[long], np.full(len(start), length)], axis=1))
    runs = np.concatenate(found) if found else np.empty((0, 4), dtype=np.int64)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def dropped_words(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words a run (start, length, period) holds after its first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges)[:n] > 0


def _answer(ids: pa.Array, texts: list[list[bytes]], min_exponent: int, min_words: int) -> pa.RecordBatch:
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    numbers = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy()
    runs = find_runs(numbers, lengths, min_exponent, min_words)
    cut = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    collapsed = []
    for k, words in enumerate(texts):
        own = runs[cut[k] : cut[k + 1], 1:]
        if len(own):
            words = [words[i] for i in np.flatnonzero(~dropped_words(own, len(words))).tolist()]
        collapsed.append(b" ".join(words).decode())
    rows = pa.StructArray.from_arrays([pa.array(runs[:, c], pa.int64()) for c in (1, 2, 3)], names=["start", "length", "period"])
    listed = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), rows)
    return pa.RecordBatch.from_arrays([ids, pa.array(lengths), listed, pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS, text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed: the words that no run holds after its first period."""
    source = docs.select("doc_id", F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[bytes]] = []
            began = n = 0
            for k, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode().split()  # bytes: exactly [\x20\x09-\x0D]
                if held and n + len(words) > WORDS_AT_ONCE:
                    yield _answer(batch.column(0).slice(began, len(held)), held, min_exponent, min_words)
                    held, began, n = [], k, 0
                held.append(words)
                n += len(words)
            if held:
                yield _answer(batch.column(0).slice(began, len(held)), held, min_exponent, min_words)

    return source.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUN_TYPE}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's test form: in a tenth of the documents, by crc32 of the id, the words from one on repeat with a period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        known = F.array(F.struct(words.alias("w"), a.alias("a"), p.alias("p"), n.alias("n")))
        again = lambda s: F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda i: F.get(s["w"], F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int")))
        return F.when(n > 0, F.array_join(F.get(F.transform(known, again), F.lit(0)), " "))

    tenth = doc_id.isNotNull() & (F.pmod(h, F.lit(10)) == 0)
    return F.when(tenth, F.get(F.transform(F.array(words_of(text)), repeat), F.lit(0))).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """periodic_runs -> the contract's columns: the strongest run and digests of all runs and of the collapsed text."""
    by_ratio, by_place = "b.length * a.period - a.length * b.period", "if(a.start <> b.start, a.start - b.start, a.period - b.period)"
    best = F.get(F.expr(f"array_sort(runs, (a, b) -> cast(sign(if({by_ratio} <> 0, {by_ratio}, {by_place})) as int))"), F.lit(0))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    named = found.withColumn("best", best)
    return named.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Stretches of period q are islands of words that equal the one q back; crc32 is written out bit by bit.
ORACLE = r"""
with recursive ids as (select distinct doc_id from documents),
crc as (
  select doc_id, 0 as k, 4294967295::bigint as c from ids where doc_id is not null
  union all
  select crc.doc_id, k + 1,
         list_reduce(list_prepend(xor(c, ascii(substr(crc.doc_id::varchar, k + 1, 1))::bigint), range(8)),
                     lambda v, x: case when v % 2 = 1 then xor(v // 2, 3988292384::bigint) else v // 2 end)
  from crc where k < length(crc.doc_id::varchar)),
h as (select doc_id, xor(c, 4294967295::bigint) as h from crc where k = length(doc_id::varchar)),
split as (
  select d.doc_id, coalesce(h.h, 1) as h, coalesce(h.h, 1) // 10 as g,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents d left join h using (doc_id)),
cut as (select *, len(w) as n, case when len(w) > 0 then g % len(w) end as a from split),
plan as (select *, 1 + (n - a) // (3 + g % 8) as p from cut),
final as (
  select doc_id, n, case when h % 10 = 0 and n > 0
    then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) else w end as w from plan),
word as (select doc_id, n, unnest(w) as word, unnest(range(n)) as i from final),
met as (select x.doc_id, x.i, y.i - x.i as q from word x join word y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and (y.i - x.i) * 4 <= x.n),
island as (select *, i - row_number() over (partition by doc_id, q order by i) as k from met),
stretch as (select doc_id, q, min(i) as s, count(*) + q as len from island group by doc_id, q, k having count(*) + q >= greatest(6, 4 * q)),
run as (
  select * from stretch a where not exists (
    select 1 from stretch b where b.doc_id = a.doc_id and b.q < a.q and b.s <= a.s and b.s + b.len >= a.s + a.len)),
lost as (select distinct doc_id, unnest(range(s + q, s + len)) as i from run),
kept as (
  select w.doc_id, string_agg(word, ' ' order by w.i) as t from word w left join lost l on w.doc_id = l.doc_id and w.i = l.i
  where l.i is null group by w.doc_id),
best as (
  select *, row_number() over (partition by doc_id order by len::double / q desc, s, q) as r from run),
told as (select doc_id, count(*) as n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as t from run group by doc_id)
select f.doc_id, coalesce(told.n_runs, 0)::bigint as n_runs, best.s::bigint as start, best.len::bigint as length, best.q::bigint as period,
       (1000 * best.len // best.q)::bigint as exponent_milli, sha256(coalesce(told.t, '')) as runs_sha256, sha256(coalesce(kept.t, '')) as collapsed_sha256
from final f left join told using (doc_id) left join best on best.doc_id = f.doc_id and best.r = 1 left join kept on kept.doc_id = f.doc_id"""
