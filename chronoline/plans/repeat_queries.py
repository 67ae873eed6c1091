"""Queries of re-timing and score pitches on texts of few words that repeat, are misheard or are missing; their SQL walks the longest common blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoline.functions import scalars as S
from chronoline.operators import alignment as A
from chronoline.operators import calibration as K
from chronoline.operators import estimators as E
from chronoline.operators import ordered as O
from chronoline.operators import retiming as RT
from chronoline.operators import score_reference as SR
from chronoline.plans.estimator_queries import CAND, SECONDS, seconds
from chronoline.plans.recursive_sql import TIERS_SQL, matched
from chronoline.plans.sequence_queries import KEY, ORDER, WIN

DAY = 86400.0


def _words(spark, sf_dir):
    """Events of a user as words, of five kinds in all, with a line each ten days."""
    ev = seconds(spark, sf_dir).withColumn("pos", (F.row_number().over(O.over(KEY, ORDER)) - 1).cast("long"))
    day = F.col("s") / DAY
    return ev.select(F.col("user_id").alias("song_id"), "pos", F.col("event_type").alias("text"), day.alias("start"), (day + 0.2).alias("end"), F.floor(day / 10).cast("long").alias("line_no"), "value")


_WORDS = f"{SECONDS}, w as (select user_id as song_id, row_number() {WIN} - 1 as pos, event_type as text, s / {DAY} as d, floor(s / {DAY} / 10)::bigint as line_no, value from t)"


def misheard_in_lines(spark, sf_dir):
    """Four words in five are heard, one in seven with another ending, one in eleven as something else, one in thirteen unsure."""
    words = _words(spark, sf_dir)
    said = F.when(F.col("pos") % 7 == 3, F.concat(F.expr("left(text, length(text) - 1)"), F.lit("x"))).when(F.col("pos") % 11 == 5, "zzz").otherwise(F.col("text"))
    sure = F.when(F.col("pos") % 13 == 6, 0.1).otherwise(0.9)
    heard = words.where("pos % 5 <> 0").select("song_id", "pos", said.alias("text"), (F.col("start") + 0.05).alias("start"), (F.col("end") + 0.05).alias("end"), sure.alias("confidence"))
    lines = words.groupBy("song_id", "line_no").agg(F.min("start").alias("t"))
    hits = RT.heard_in_lines(words, lines, heard, ["song_id"])
    return hits.select("song_id", "pos", F.round("heard_start", 4).alias("heard_start"))


MISHEARD_SQL = f"""
with recursive {_WORDS}, l as (select song_id, line_no, min(d) as lo from w group by all),
e as (select *, coalesce(lead(lo) over (partition by song_id order by line_no), lo + 5) as hi from l),
h as (select song_id, pos, d + 0.05 as d, case when pos % 7 = 3 then left(text, length(text) - 1) || 'x' when pos % 11 = 5 then 'zzz' else text end as text, pos % 13 <> 6 as sure from w where pos % 5 <> 0),
lf as (select song_id * 10000 + line_no as k, row_number() over (partition by song_id, line_no order by pos) - 1 as pos, text as w, pos as word from w),
rt as (select h.song_id * 10000 + line_no as k, row_number() over (partition by h.song_id, line_no order by d, pos) - 1 as pos, text as w, d, sure from h join e on h.song_id = e.song_id and d between lo - 0.5 and hi + 0.5),
{matched("mt", "lf", "rt")},
n as (select k, count(*) as m from rt group by k),
g as (select lf.*, mt.j, coalesce(1 + max(mt.i) over f, 0) as a0, coalesce(1 + max(mt.j) over f, 0) as b0, coalesce(min(mt.i) over b, count(*) over (partition by lf.k)) as a1, coalesce(min(mt.j) over b, n.m) as b1
  from lf join n on n.k = lf.k left join mt on mt.k = lf.k and mt.i = lf.pos
  window f as (partition by lf.k order by lf.pos rows between unbounded preceding and current row), b as (partition by lf.k order by lf.pos rows between current row and unbounded following)),
lone as (select g.k, g.word, g.w as ours, rt.w as theirs, rt.pos as place, rt.d, rt.sure from g join rt on rt.k = g.k and rt.pos >= g.b0 and rt.pos < g.b1 where g.j is null and g.a1 - g.a0 = 1),
pk as (select distinct ours || '|' || theirs as k, ours as a, theirs as b from lone),
ca as (select k, generate_subscripts(string_split(a, ''), 1) - 1 as pos, unnest(string_split(a, '')) as w from pk),
cb as (select k, generate_subscripts(string_split(b, ''), 1) - 1 as pos, unnest(string_split(b, '')) as w from pk),
{matched("mc", "ca", "cb")},
al as (select a, b, 2.0 * coalesce((select count(*) from mc where mc.k = pk.k), 0) / (length(a) + length(b)) as ratio from pk),
best as (select lone.*, ratio, row_number() over (partition by lone.k, word order by ratio desc, place) as r from lone join al on al.a = ours and al.b = theirs),
hit as (select g.k, word, rt.d, rt.sure from g join rt on rt.k = g.k and rt.pos = g.j union all select k, word, d, sure from best where r = 1 and ratio >= 0.6)
select k // 10000 as song_id, word::bigint as pos, round(d, 4) as heard_start from hit where sure"""


def repeated_score_pitches(spark, sf_dir):
    """A score that lacks one word in four and sings three steps higher, one in five of its words a step more."""
    syllables = _words(spark, sf_dir).select("song_id", "pos", "text", F.floor(F.col("value") / 20).cast("long").alias("pitch"), (F.col("value") / 500).alias("confidence"))
    midi = F.col("pitch") + 63 + (F.col("pos") % 5 == 0).cast("long")
    notes = syllables.where("pos % 4 <> 2").select("song_id", F.col("pos").cast("double").alias("offset"), midi.alias("midi"), F.col("text").alias("norm"))
    out = SR.correct_syllables(syllables, notes)
    return out.select("song_id", "pos", "pitch", F.round("confidence", 6).alias("confidence"))


REPEATED_SCORE_SQL = f"""
with recursive {_WORDS}, lf as (select song_id as k, pos, text as w, floor(value / 20)::bigint as p, value / 500 as c from w),
rt as (select k, row_number() over (partition by k order by pos) - 1 as pos, w, p + 63 + (pos % 5 = 0)::int as midi from lf where pos % 4 <> 2),
{matched("mt", "lf", "rt")},
m as (select mt.k, mt.i as pos, p, c, midi, ((midi - (p + 60)) % 12 + 12) % 12 as b from mt join lf on lf.k = mt.k and lf.pos = mt.i join rt on rt.k = mt.k and rt.pos = mt.j),
r as (select *, row_number() over (partition by k order by c desc, pos) as rk, count(*) over (partition by k) as n from m),
v as (select k, b, n, count(*) as agree, min(pos) as first from r group by all), f as (select *, row_number() over (partition by k order by agree desc, first) as o from v),
hv as (select k, b, count(*) as agree, min(rk) as first from r where rk <= greatest(8, floor(n / 2.0)) group by all),
hf as (select *, sum(agree) over (partition by k) as hn, row_number() over (partition by k order by agree desc, first) as o from hv),
j as (select f.k, f.n, f.b as b1, f.agree / f.n as s1, hf.b as b2, hf.agree / hf.hn as s2 from f join hf on f.k = hf.k and f.o = 1 and hf.o = 1),
x as (select k, case when n < 8 then null when s1 >= 0.5 then b1 when s2 >= 0.4 or s2 > s1 then b2 else b1 end as off from j),
u as (select m.k, m.pos, p, (((midi - off) % 12 - p) % 12 + 24) % 12 as up from m join x using (k) where off is not null),
y as (select k, pos, p + case when up > 6 then up - 12 else up end as np from u)
select lf.k as song_id, lf.pos::bigint as pos, coalesce(np, p)::bigint as pitch, round(case when coalesce(np, p) <> p then greatest(c, 0.75) else c end, 6) as confidence from lf left join y on y.k = lf.k and y.pos = lf.pos"""


def _shaken(spark, sf_dir):
    """Candidates five seconds apart: of four users one is off by a constant, one drifts, one scatters by three seconds and one by six."""
    pos = F.row_number().over(O.over(KEY, ORDER)) - 1
    ev = seconds(spark, sf_dir).select("user_id", "t_us", "event_id", pos.alias("i"))
    kind, small = F.col("user_id") % 4, F.col("event_id") % 97 / 1000
    delta = F.when(kind == 0, 2.0).when(kind == 1, F.col("i") * 0.5).when(kind == 2, F.col("i") * 5 % 9 - 4.0).otherwise(F.col("i") * 5 % 13 - 6.0)
    return ev.select("user_id", "t_us", "event_id", (F.col("i") * 5.0).alias("x"), (delta + small).alias("delta"))


_SHAKEN = f"""{SECONDS}, si as (select *, row_number() {WIN} - 1 as i from t),
ca as (select user_id, t_us, event_id, i * 5.0::double as x, (case user_id % 4 when 0 then 2.0 when 1 then i * 0.5 when 2 then i * 5 % 9 - 4.0 else i * 5 % 13 - 6.0 end)::double + event_id % 97 / 1000 as delta from si)"""


def _tiers(summary, anchors):
    counted = anchors.groupBy(*KEY).agg(F.count("*").alias("anchors"))
    return summary.join(counted, KEY, "left").select("user_id", F.coalesce("kind", F.lit("")).alias("kind"), F.round("confidence", 6).alias("confidence"), F.coalesce("anchors", F.lit(0)).alias("anchors"))


def shaken_tiers(spark, sf_dir):
    """Calibration of candidates that reach every tier."""
    return _tiers(*K.calibrate(_shaken(spark, sf_dir), KEY, ORDER, "x", "delta"))


SHAKEN_SQL = TIERS_SQL.replace(CAND, _SHAKEN)


def rescued_tiers(spark, sf_dir):
    """The same where songs whose repeated lines match open the last tier: every third user's lyric lacks a quarter of the lines."""
    lines = seconds(spark, sf_dir).select("user_id", F.col("event_id").alias("line_no"), F.concat("event_type", F.lit(" again")).alias("line"))
    theirs = lines.where(~((F.col("user_id") % 3 == 0) & (F.col("line_no") % 4 == 0)))
    same = A.repeat_structure(lines, theirs, "user_id", S.normalize_word).where("not differs")
    return _tiers(*K.calibrate(_shaken(spark, sf_dir), KEY, ORDER, "x", "delta", rescued=same))


_SAME = """with recursive nl as (select user_id, event_type, count(*) as c, count(*) filter (where user_id % 3 = 0 and event_id % 4 = 0) as gone from events group by all),
ok as (select user_id from nl group by user_id having max(c) >= 3 and sum(gone) <= greatest(1.0, round_even(sum(c) * 0.15, 0))), """
RESCUED_SQL = SHAKEN_SQL.replace("with recursive ", _SAME, 1).replace("greatest(share1, share2) >= 0.3", "(greatest(share1, share2) >= 0.3 or user_id in (select user_id from ok))")

BINS = 48


def note_classes(spark, sf_dir):
    """Purchases as notes of two days, other events as frames of 48 bins each, in days."""
    ev = seconds(spark, sf_dir).select("user_id", "event_id", "event_type", (F.col("s") / DAY).alias("day"), F.round("value").cast("long").alias("v"))
    notes = ev.where("event_type = 'purchase'").select("user_id", "event_id", "day", (F.col("day") + 2).alias("end"))
    bins = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: ((F.col("v") * (k + 1)) % 11).cast("double"))
    frames = ev.where("event_type <> 'purchase'").select("user_id", "day", bins.alias("bins"))
    mass = E.note_class_mass(notes, frames, ["user_id"], "event_id", "day", "end", "day", "bins")
    return mass.select("user_id", "event_id", F.col("pc").cast("long").alias("pc"), F.col("mass").cast("long").alias("mass"))


NOTE_CLASSES_SQL = f"""
with {SECONDS}, e as (select user_id, event_id, event_type, s / {DAY} as d, round(value)::bigint as v from t),
f as (select * from e where event_type <> 'purchase'), n as (select * from e where event_type = 'purchase'),
i as (select n.user_id, n.event_id, f.v from n join f on f.user_id = n.user_id and f.d between n.d and n.d + 2),
x as (select n.user_id, n.event_id, arg_min(f.v, f.d) as v from n join f on f.user_id = n.user_id and f.d >= n.d where n.event_id not in (select event_id from i) group by all),
a as (select * from i union all select * from x), k as (select k, (round_even(69 + 12 * log2(10 * pow(2, (1997.3794084376191 + 20 * k) / 1200) / 440.0), 0)::bigint % 12 + 12) % 12 as pc from range({BINS}) r(k))
select user_id, event_id, pc, sum((v * (k + 1)) % 11)::bigint as mass from a, k group by all"""

QUERIES = {"misheard_in_lines": misheard_in_lines, "repeated_score_pitches": repeated_score_pitches, "shaken_tiers": shaken_tiers, "rescued_tiers": rescued_tiers, "note_classes": note_classes}
ORACLES = {"misheard_in_lines": MISHEARD_SQL, "repeated_score_pitches": REPEATED_SCORE_SQL, "shaken_tiers": SHAKEN_SQL, "rescued_tiers": RESCUED_SQL, "note_classes": NOTE_CLASSES_SQL}
