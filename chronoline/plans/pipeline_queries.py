"""Queries of the whole-song pipelines, line breaks, calibration tiers and key correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoline.functions import hyphenation as H
from chronoline.functions.syllables import syllables
from chronoline.operators import alignment as A
from chronoline.operators import calibration as K
from chronoline.operators import ordered as O
from chronoline.operators import phrasing as P
from chronoline.operators import retiming as RT
from chronoline.plans import pipelines
from chronoline.plans.estimator_queries import _candidates, seconds
from chronoline.plans.sequence_queries import EV, KEY, ORDER, PRE, UPTO, WIN, events
from chronoline.session import table
from chronoline.sources import charts as C



def _syllables(spark, sf_dir):
    """Events as syllables in hours: a line each twenty days, unknown for high values; word starts at sign-ups and views."""
    ev = seconds(spark, sf_dir)
    day = F.floor(F.col("s") / 1728000).cast("long")
    return ev.select(
        "user_id", "t_us", "event_id", (F.col("s") / 3600).alias("start"), (F.col("s") / 3600 + F.col("value") / 2000).alias("end"), F.concat("event_type", F.when(F.col("value") > 300, ",").otherwise("")).alias("text"),
        F.when(F.col("value") < 480, day).alias("line_id"), F.col("event_type").isin("signup", "view").alias("is_word_start"),
    )


def strict_lines(spark, sf_dir):
    return P.strict_breaks(_syllables(spark, sf_dir), KEY, ORDER).select("user_id", "event_id", "break_before")


STRICT_SQL = f"""
with {EV}, t as (select *, (t_us - min(t_us) over (partition by user_id)) / 1e6 as s from ev),
y as (select *, case when value < 480 then floor(s / 1728000)::bigint end as line, event_type in ('signup', 'view') as ws from t),
l as (select *, last_value(case when ws then line end ignore nulls) {PRE} as last_line from y)
select user_id, event_id, coalesce(ws and line <> last_line, false) as break_before from l"""


def overflow_lines(spark, sf_dir):
    return P.overflow_breaks(_syllables(spark, sf_dir), KEY, ORDER, 4).select("user_id", "event_id")


OVERFLOW_SQL = f"""
with {EV}, t as (select *, (t_us - min(t_us) over (partition by user_id)) / 1e6 as s from ev),
y as (select *, case when value < 480 then floor(s / 1728000)::bigint end as line, event_type in ('signup', 'view') as ws, event_type || case when value > 300 then ',' else '' end as text from t),
c as (select *, case when line is not distinct from lag(line) {WIN} and row_number() {WIN} > 1 then 0 else 1 end as o from y), r as (select *, sum(o) {UPTO} as run from c),
n as (select *, row_number() over (partition by user_id, run order by t_us, event_id) - 1 as i, count(*) over (partition by user_id, run) as n, sum(ws::int) over (partition by user_id, run order by t_us, event_id) as w,
  sum(ws::int) over (partition by user_id, run) as wn, lag(text) over (partition by user_id, run order by t_us, event_id) as pt from r where line is not null),
k as (select *, row_number() over (partition by user_id, run order by abs(i - n / 2), i) as rk from n where n >= 4 and ws and w > 1 and w < wn and wn >= 3 and (ends_with(pt, ',') or ends_with(pt, '.')))
select user_id, event_id from k where rk = 1"""


def free_lines(spark, sf_dir):
    return P.free_breaks(_syllables(spark, sf_dir), KEY, ORDER).where("break_before").select("user_id", "event_id")


def key_nudge(spark, sf_dir):
    ev = events(spark, sf_dir).select("user_id", "event_id", F.pmod(F.floor(F.col("value") / 7), F.lit(12)).cast("long").alias("pc"))
    keys = K.likely_key(ev, KEY, "pc")
    out = K.nudge(ev, keys, KEY, "pc")
    return out.join(keys, KEY).select("user_id", "event_id", F.col("song_key").cast("long").alias("song_key"), F.col("nudged").cast("long").alias("nudged"))


_TABLE = ", ".join(f"({k}, {pc}, {v})" for k, row in enumerate(K.KEY_TABLE) for pc, v in enumerate(row))
NUDGE_SQL = f"""
with {EV}, c as (select user_id, event_id, floor(value / 7)::bigint % 12 as pc from ev), kt(k, pc, p) as (values {_TABLE}),
n as (select user_id, pc, count(*) as n from c group by all), w as (select user_id, k, round_even(sum(p * n)::double, 9) as w from n join kt using (pc) group by all),
b as (select user_id, k from (select *, row_number() over (partition by user_id order by w desc, k) as r from w) where r = 1)
select c.user_id, event_id, b.k::bigint as song_key, (case when p0.p > 0 then c.pc when pu.p >= pd.p then (c.pc + 1) % 12 else (c.pc + 11) % 12 end)::bigint as nudged
from c join b using (user_id) join kt p0 on p0.k = b.k and p0.pc = c.pc join kt pu on pu.k = b.k and pu.pc = (c.pc + 1) % 12 join kt pd on pd.k = b.k and pd.pc = (c.pc + 11) % 12"""


def calibration_tiers(spark, sf_dir):
    summary, anchors = K.calibrate(_candidates(spark, sf_dir), KEY, ORDER, "x", "delta")
    counted = anchors.groupBy(*KEY).agg(F.count("*").alias("anchors"))
    return summary.join(counted, KEY, "left").select("user_id", F.coalesce("kind", F.lit("")).alias("kind"), F.round("confidence", 6).alias("confidence"), F.coalesce("anchors", F.lit(0)).alias("anchors"))


def word_syllables(spark, sf_dir):
    words = table(spark, sf_dir, "part").select("p_name").distinct()
    return words.select(F.explode(F.split("p_name", " ")).alias("word")).distinct().withColumn("parts", F.array_join(syllables("word"), "|"))


def _words(spark, sf_dir):
    """Words of part names and types and market segments."""
    parts, customers = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    texts = parts.select(F.concat_ws(" ", "p_name", "p_type").alias("t")).union(customers.select("c_mktsegment"))
    return texts.select(F.explode(F.split(F.lower("t"), "[^a-z]+")).alias("word")).where("word <> ''").distinct()


def pattern_cuts(spark, sf_dir):
    """Letters three by three of the words, with digits from their codes, as patterns; the first half of each word as a common word."""
    words = _words(spark, sf_dir)
    three = words.select(F.explode(F.expr("transform(sequence(1, greatest(1, length(word))), i -> substr(concat('.', word, '.'), i, 3))")).alias("p")).where("length(p) = 3").distinct()
    digit = lambda k: F.expr(f"cast((ascii(substr(p, 1, 1)) * 3 + ascii(substr(p, 2, 1)) * 5 + ascii(substr(p, 3, 1)) * 7 + {k} * 11) % 4 as string)")
    spelt = F.concat(*(c for k in range(3) for c in (digit(k), F.substring("p", k + 1, 1))), digit(3))
    patterns = [r["s"] for r in three.select(spelt.alias("s")).collect()]  # bounded by the alphabet; they stand for a dictionary's file
    common = [r["w"] for r in words.select(F.expr("left(word, (length(word) + 1) div 2)").alias("w")).distinct().collect()]
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return words.select("word", shown(H.cuts_with(spark, patterns)("word")).alias("cuts"), shown(F.array_sort(H.prefixes_with(spark, common)("word"))).alias("prefixes"))


PATTERN_SQL = """
with t as (select p_name || ' ' || p_type as t from part union all select c_mktsegment from customer),
w as (select distinct unnest(string_split_regex(lower(t), '[^a-z]+')) as word from t),
x as (select word, '.' || word || '.' as f from w where word <> ''),
g as (select word, f, unnest(range(1, length(f) - 1)) as i from x),
v as (select word, i + k as place, max((ascii(substr(f, i, 1)) * 3 + ascii(substr(f, i + 1, 1)) * 5 + ascii(substr(f, i + 2, 1)) * 7 + k * 11) % 4) as v
  from g, range(4) as r(k) group by all),
c as (select word, string_agg((place - 2)::varchar, ',' order by place) as cuts from v where v % 2 = 1 and place - 2 between 2 and length(word) - 2 group by word),
h as (select distinct left(word, (length(word) + 1) // 2) as h from x),
p as (select word, string_agg(length(h)::varchar, ',' order by length(h)) as prefixes from x join h on starts_with(word, h) group by word)
select x.word, coalesce(cuts, '') as cuts, coalesce(prefixes, '') as prefixes from x left join c using (word) left join p using (word)"""


def generated_charts(spark, sf_dir):
    ev = seconds(spark, sf_dir).withColumn("pos", (F.row_number().over(O.over(KEY, ORDER)) - 1).cast("long"))
    hour = F.col("s") / 3600
    words = ev.where("event_type in ('signup', 'view')").select(F.col("user_id").alias("song_id"), "pos", F.concat("event_type", F.lit("ing")).alias("text"), hour.alias("start"), (hour + F.col("value") / 500).alias("end"), F.lit(None).cast("long").alias("line_id"))
    notes = ev.where("event_type not in ('signup', 'view')").select(F.col("user_id").alias("song_id"), "pos", hour.alias("start"), (hour + F.col("value") / 300).alias("end"), F.floor(F.col("value") / 50).cast("long").alias("pitch"), (F.col("value") / 500).alias("confidence"), F.lit(False).alias("protected"))
    out = pipelines.generate_entries(words, notes)
    return out.select("song_id", "entry", "kind", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), F.coalesce("pitch", F.lit(-99)).alias("pitch"), F.coalesce("text", F.lit("")).alias("text"))


def retimed_words(spark, sf_dir):
    ev = seconds(spark, sf_dir).withColumn("pos", (F.row_number().over(O.over(KEY, ORDER)) - 1).cast("long"))
    words = ev.select(F.col("user_id").alias("song_id"), "pos", F.concat("event_type", (F.floor("value") % 9).cast("string")).alias("text"), (F.col("s") / 3600).alias("start"), (F.col("s") / 3600 + 0.1).alias("end"))
    heard = words.where("pos % 3 <> 0").withColumns({"start": F.col("start") + 2.0 + (F.col("pos") % 5) * 0.05, "end": F.col("end") + 2.1})
    out = RT.retime(words, heard)
    return out.select("song_id", "pos", F.round("new_start", 4).alias("new_start"), F.round("new_end", 4).alias("new_end"), "placed")


def refreshed_pitches(spark, sf_dir):
    ev = seconds(spark, sf_dir).withColumn("pos", (F.row_number().over(O.over(KEY, ORDER)) - 1).cast("long"))
    hour = F.col("s") / 3600
    notes = ev.where("event_type = 'purchase'").select(F.col("user_id").alias("song_id"), "pos", hour.alias("start"), (hour + 20).alias("end"), F.floor(F.col("value") / 40).cast("long").alias("pitch"))
    frames = ev.select(F.col("user_id").alias("song_id"), hour.alias("t"), (F.lit(50) + F.col("value") / 20).alias("midi"), (F.col("value") / 500).alias("conf"), (F.col("event_type") != "error").alias("voiced"))
    return pipelines.refresh_pitches(notes, frames, 1.0, 24.0).select("song_id", "pos", "pitch", "new_pitch")


def _turn_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), "text")
    return C.parse_lyrics(c, "k", "text")


def reconciled_lines(spark, sf_dir):
    """Lines of each turn against the same lines without every fourth, four seconds apart."""
    ours = _turn_lines(spark, sf_dir)
    theirs = ours.where("line_no % 4 <> 3").withColumn("t", F.col("line_no") * 4.0)
    return A.reconcile_lines(ours, theirs, "k").select("k", "our_line", F.round("t", 4).alias("t"))


def voted_lines(spark, sf_dir):
    tokens = C.tokenize(_turn_lines(spark, sf_dir), "k")
    other = tokens.where("pos % 5 <> 4").withColumn("line_no", F.col("line_no") + 10)
    return A.line_votes(A.match_words(tokens, other, ["k"], "norm", "norm"), tokens, other, "k")


QUERIES = {
    "reconciled_lines": reconciled_lines, "voted_lines": voted_lines,
    "strict_lines": strict_lines, "overflow_lines": overflow_lines, "free_lines": free_lines, "key_nudge": key_nudge, "calibration_tiers": calibration_tiers,
    "word_syllables": word_syllables, "pattern_cuts": pattern_cuts, "generated_charts": generated_charts, "retimed_words": retimed_words, "refreshed_pitches": refreshed_pitches,
}
ORACLES = {"strict_lines": STRICT_SQL, "overflow_lines": OVERFLOW_SQL, "key_nudge": NUDGE_SQL, "pattern_cuts": PATTERN_SQL}
