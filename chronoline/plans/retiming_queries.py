"""Queries of re-timing and of pitch correction by scores. Days stand for seconds; texts that occur once make the alignments plain joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoline.functions import scalars as S
from chronoline.operators import alignment as A
from chronoline.operators import ordered as O
from chronoline.operators import retiming as RT
from chronoline.operators import score_placement as SP
from chronoline.operators import score_reference as SR
from chronoline.plans.estimator_queries import SECONDS, seconds
from chronoline.plans.sequence_queries import KEY, ORDER, WIN
from chronoline.session import table
from chronoline.sources import listings as L

DAY = 86400.0


def _words(spark, sf_dir):
    """Events of a user as words that occur once and are not alike, with a place, a day and a line each ten days."""
    ev = seconds(spark, sf_dir).withColumn("pos", (F.row_number().over(O.over(KEY, ORDER)) - 1).cast("long"))
    day = F.col("s") / DAY
    return ev.select(
        F.col("user_id").alias("song_id"), "pos", F.md5(F.col("event_id").cast("string")).alias("text"), day.alias("start"),
        (day + 0.2).alias("end"), F.floor(day / 10).cast("long").alias("line_no"), "value", F.lit(True).alias("is_word_start"),
    )


_WORDS = f"{SECONDS}, w as (select user_id as song_id, row_number() {WIN} - 1 as pos, s / {DAY} as d, floor(s / {DAY} / 10)::bigint as line_no, value from t)"


def _heard(words):
    """Two words in three, two days late, one in seven of them unsure."""
    sure = F.when(F.col("pos") % 7 == 3, 0.1).otherwise(0.9)
    return words.where("pos % 3 <> 0").select("song_id", "pos", "text", (F.col("start") + 2).alias("start"), (F.col("end") + 2.1).alias("end"), sure.alias("confidence"))


def heard_words(spark, sf_dir):
    words = _words(spark, sf_dir)
    hits = RT.heard_in_order(words, _heard(words), ["song_id"])
    return hits.select("song_id", "pos", F.round("heard_start", 4).alias("heard_start"), F.round("heard_end", 4).alias("heard_end"))


HEARD_SQL = f"""
with {_WORDS} select song_id, pos::bigint as pos, round(d + 2, 4) as heard_start, round(d + 0.2 + 2.1, 4) as heard_end from w where pos % 3 <> 0 and pos % 7 <> 3"""


def _line_times(words):
    return words.groupBy("song_id", "line_no").agg(F.min("start").alias("t"))


def heard_in_lines(spark, sf_dir):
    words = _words(spark, sf_dir)
    hits = RT.heard_in_lines(words, _line_times(words), _heard(words), ["song_id"])
    return hits.select("song_id", "pos", F.round("heard_start", 4).alias("heard_start"))


HEARD_LINES_SQL = f"""
with {_WORDS}, l as (select song_id, line_no, min(d) as lo from w group by all), e as (select *, coalesce(lead(lo) over (partition by song_id order by line_no), lo + 5) as hi from l)
select song_id, pos::bigint as pos, round(d + 2, 4) as heard_start from w join e using (song_id, line_no) where pos % 3 <> 0 and pos % 7 <> 3 and d + 2 between lo - 0.5 and hi + 0.5"""


def near_lines(spark, sf_dir):
    words = _words(spark, sf_dir)
    near = RT.heard_near_lines(_line_times(words), _heard(words), ["song_id"])
    return near.groupBy("song_id", "line_no").agg(F.count("*").alias("words"), F.min("pos").alias("first_pos"))


NEAR_SQL = f"""
with {_WORDS}, l as (select song_id, line_no, min(d) as lo from w group by all), e as (select *, coalesce(lead(lo) over (partition by song_id order by line_no), lo + 5) as hi from l)
select e.song_id, e.line_no, count(*) as words, min(pos)::bigint as first_pos from e join w on w.song_id = e.song_id and pos % 3 <> 0 and d + 2 between lo - 0.5 and hi + 0.5 group by all"""


def line_chunks(spark, sf_dir):
    """Chunks of songs with lines, and of every third song without."""
    words = _words(spark, sf_dir).withColumn("line_no", F.when(F.col("song_id") % 3 != 0, F.col("line_no")))
    return RT.with_chunks(words, ["song_id"]).select("song_id", "pos", F.col("chunk").cast("long").alias("chunk"))


CHUNKS_SQL = f"""
with {_WORDS}, c as (select *, (coalesce(line_no <> lag(line_no) over (partition by song_id order by pos), false))::int as opens from w)
select song_id, pos::bigint as pos, case when song_id % 3 <> 0 then sum(opens) over (partition by song_id order by pos) else pos // 6 end::bigint as chunk from c"""


def windowed_words(spark, sf_dir):
    words = _words(spark, sf_dir)
    lines = _line_times(words.where("song_id % 2 = 0")).withColumn("t", F.col("t") + 2)
    out = RT.retime(words, _heard(words), lines, "windowed")
    return out.select("song_id", "pos", "source", F.round("new_start", 4).alias("new_start"))


def validated_words(spark, sf_dir):
    """Every fifth song is heard with times that do not fit: it is matched as a whole, and lines seed what was not heard."""
    words = _words(spark, sf_dir)
    spread = F.when(F.col("song_id") % 5 == 0, F.col("pos") * F.col("pos") % 40).otherwise(0.0)
    heard = _heard(words).withColumns({"start": F.col("start") + spread, "end": F.col("end") + spread})
    out = RT.retime(words, heard, _line_times(words).withColumn("t", F.col("t") + 2))
    return out.select("song_id", "pos", "source", F.round("new_start", 4).alias("new_start"))


def chart_timing(spark, sf_dir):
    words = _words(spark, sf_dir).withColumnRenamed("text", "norm").withColumn("line_no", F.floor(F.col("start") / 2).cast("long"))
    ours = words.groupBy("song_id", "line_no").agg(F.min("start").alias("start"))
    off = F.when(F.col("line_no") % 6 == 5, 4.0).otherwise(0.0)
    theirs = ours.select("song_id", "line_no", (F.col("start") - 3 + off).alias("t"))
    _, lines = RT.line_timing(ours, theirs, words, words, "song_id")
    return lines.select("song_id", "line_no", F.round("residual", 3).alias("residual"), "flagged")


CHART_SQL = f"""
with {_WORDS}, l as (select distinct song_id, floor(d / 2)::bigint as line_no from w), o as (select *, case when line_no % 6 = 5 then -1 else 3 end as delta from l),
c as (select song_id, delta, count(*) as n, min(line_no) as first from o group by all),
b as (select song_id, delta as offs from (select *, row_number() over (partition by song_id order by n desc, first) as r, sum(n) over (partition by song_id) as total from c) where r = 1 and total >= 5)
select song_id, line_no, round((delta - offs)::double, 3) as residual, abs(delta - offs) > 2 as flagged from o join b using (song_id)"""


def score_pitches(spark, sf_dir):
    syllables = _words(spark, sf_dir).select("song_id", "pos", "text", F.floor(F.col("value") / 20).cast("long").alias("pitch"), (F.col("value") / 500).alias("confidence"))
    midi = F.col("pitch") + 63 + (F.col("pos") % 5 == 0).cast("long")
    notes = syllables.where("pos % 4 <> 2").select("song_id", F.col("pos").cast("double").alias("offset"), midi.alias("midi"), F.col("text").alias("norm"))
    out = SR.correct_syllables(syllables, notes)
    return out.select("song_id", "pos", "pitch", F.round("confidence", 6).alias("confidence"))


SCORE_SQL = f"""
with {_WORDS}, c as (select *, sum((pos % 4 <> 2)::int) over (partition by song_id) >= 8 and pos % 4 <> 2 and pos % 5 = 0 as moves from w)
select song_id, pos::bigint as pos, (floor(value / 20) + moves::int)::bigint as pitch, round(case when moves then greatest(value / 500, 0.75) else value / 500 end, 6) as confidence from c"""


def score_words(spark, sf_dir):
    """Words of one and two notes in turn; the score sings every third word on three notes, of one, two and three quarters."""
    words = _words(spark, sf_dir)
    entries = words.select(
        "song_id", "pos", F.when(F.col("pos") % 3 == 2, "~").otherwise(F.col("text")).alias("text"), "start", "end",
        F.floor(F.col("value") / 20).cast("long").alias("pitch"), (F.col("value") / 500).alias("confidence"), (F.col("pos") % 3 != 2).alias("is_word_start"),
    )
    sung = entries.where("is_word_start").withColumn("pos", (F.row_number().over(O.over(["song_id"], ["pos"])) - 1).cast("long"))
    many = F.when(F.col("pos") % 3 == 0, F.sequence(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    notes = F.transform(many, lambda i: F.struct((i + 1).cast("double").alias("qlen"), (F.col("pitch") + 63 + i).alias("midi")))
    out = SR.correct_words(entries, sung.select("song_id", "pos", F.col("text").alias("norm"), notes.alias("syllables")))
    return out.select("song_id", "pos", "k", "text", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "pitch", "is_word_start")


SCORE_WORDS_SQL = f"""
with {_WORDS}, i as (select user_id as song_id, row_number() {WIN} - 1 as pos, md5(event_id::varchar) as text from t),
e as (select w.*, text, floor(value / 20)::bigint as p, sum((pos % 3 <> 2)::int) over (partition by song_id order by pos) - 1 as word, sum((pos % 3 <> 2)::int) over (partition by song_id) as words from w join i using (song_id, pos)),
n as (select *, count(*) over (partition by song_id, word) as n, sum((pos % 3 <> 2 or word % 3 = 0)::int) over (partition by song_id) >= 8 as used,
  first_value(p) over (partition by song_id, word order by pos) as p0, row_number() over (partition by song_id, word order by pos) - 1 as i from e),
k as (select *, unnest(case when used and n = 1 and word % 3 = 0 then [0, 1, 2] else [0] end) as k from n),
m as (select *, p0 + case when word % 3 <> 0 then 0 when n = 1 then k else i * 2 end as target, used and n = 1 and word % 3 = 0 as several from k),
o as (select *, ((target - p) % 12 + 12) % 12 as up from m)
select song_id, pos::bigint as pos, k::int as k, case when k > 0 or pos % 3 = 2 then '~' else text end as text,
  round(case when several then d + [0, 1, 3][k + 1] / 6 * 0.2 else d end, 4) as start, round(case when several then d + [1, 3, 6][k + 1] / 6 * 0.2 else d + 0.2 end, 4) as "end",
  (case when used then p + case when up > 6 then up - 12 else up end else p end)::bigint as pitch, k = 0 and pos % 3 <> 2 as is_word_start from o"""


def _score_song(spark, sf_dir):
    """Every event a score's word of one note of a quarter, a lyric without one word in four."""
    words = _words(spark, sf_dir)
    note = F.struct(F.col("pos").cast("double").alias("off"), F.lit(1.0).alias("qlen"), (F.lit(60) + F.col("pos") % 12).alias("midi"), F.col("text").alias("text"))
    score = words.select("song_id", "pos", "text", F.col("text").alias("norm"), F.col("pos").cast("double").alias("offset"), F.array(note).alias("syllables"))
    held = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ")
    lines = words.where("pos % 4 <> 1").groupBy("song_id", "line_no").agg(F.min("start").alias("t"), held.alias("line"))
    return words, score, lines


def score_lines(spark, sf_dir):
    _, score, lines = _score_song(spark, sf_dir)
    return SP.lines_for_words(score, lines).select("song_id", "pos", "line_no", F.coalesce("clean_text", F.lit("")).alias("clean_text"))


SCORE_LINES_SQL = f"""
with {_WORDS}, i as (select user_id as song_id, row_number() {WIN} - 1 as pos, md5(event_id::varchar) as text from t),
l as (select song_id, pos, case when pos % 4 <> 1 then line_no end as line, case when pos % 4 <> 1 then text else '' end as clean_text from w join i using (song_id, pos))
select song_id, pos::bigint as pos, last_value(line ignore nulls) over (partition by song_id order by pos rows between unbounded preceding and current row) as line_no, clean_text from l"""


def score_placement(spark, sf_dir):
    words, score, lines = _score_song(spark, sf_dir)
    heard = _heard(words).withColumns({"start": F.col("start") - 2, "end": F.col("end") - 2.1})
    placed = SP.place_words(SP.lines_for_words(score, lines), lines, heard)
    return placed.select("song_id", "pos", "placed_by", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "pushed")


def score_charts(spark, sf_dir):
    words, score, lines = _score_song(spark, sf_dir)
    heard = _heard(words).withColumns({"start": F.col("start") - 2, "end": F.col("end") - 2.1})
    made, _ = SP.chart_from_score(score, lines, heard)
    return made.select("song_id", "pos", "k", "text", "pitch", F.round("start", 4).alias("start"), "is_word_start")


def unheard_runs(spark, sf_dir):
    """Two reference words in five are not heard; a run's texts are joined."""
    words = _words(spark, sf_dir)
    tokens = words.select("song_id", "pos", F.col("text").alias("norm"), F.col("text").alias("original"), "line_no")
    runs = A.unheard_runs(words.where("pos % 5 not in (2, 3)"), tokens, "song_id")
    return runs.select("song_id", "run", F.round("window_start", 4).alias("window_start"), F.round("window_end", 4).alias("window_end"), F.array_join("texts", " ").alias("texts"))


UNHEARD_SQL = f"""
with {_WORDS}, i as (select user_id as song_id, row_number() {WIN} - 1 as pos, md5(event_id::varchar) as text from t),
h as (select *, row_number() over (partition by song_id order by pos) - 1 as i, max(d + 0.2) over (partition by song_id) as total from w where pos % 5 not in (2, 3)),
g as (select song_id, pos // 5 * 3 + 2 as run, string_agg(text, ' ' order by pos) as texts from i where pos % 5 in (2, 3) group by all)
select g.song_id, run::bigint as run, round(least(b.d + 0.2, b.total), 4) as window_start, round(least(coalesce(a.d, b.total), b.total), 4) as window_end, texts
from g join h b on b.song_id = g.song_id and b.i = run - 1 left join h a on a.song_id = g.song_id and a.i = run"""


def spliced_words(spark, sf_dir):
    """Every second run comes back from the aligner as one word."""
    words = _words(spark, sf_dir).withColumn("confidence", F.lit(0.9))
    kept = words.where("pos % 5 not in (2, 3)")
    back = words.where("pos % 10 = 2").withColumns({"run": F.floor(F.col("pos") / 5) * 3 + 2, "k": F.lit(0)})
    return A.splice_runs(kept, back, "song_id").select("song_id", "pos", "text", "recovered")


SPLICED_SQL = f"""
with {_WORDS}, i as (select user_id as song_id, row_number() {WIN} - 1 as pos, md5(event_id::varchar) as text from t)
select song_id, row_number() over (partition by song_id order by pos) - 1 as pos, text, pos % 5 = 2 as recovered from i where pos % 5 not in (2, 3) or pos % 10 = 2"""


def first_releases(spark, sf_dir):
    """Orders as releases of their customers; urgent ones have no date."""
    date = F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    releases = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("release_id"), date.alias("date"))
    return L.first_release(releases, "o_custkey")


RELEASES_SQL = """
select o_custkey, arg_min(o_orderkey::varchar, (o_orderpriority = '1-URGENT', case when o_orderpriority <> '1-URGENT' then o_orderdate::date end, o_orderkey)) as release_id from orders group by all"""


def unmarked_names(spark, sf_dir):
    names = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" [DUET]"), F.col("p_size").cast("string"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", S.without_duet_mark(names).alias("name"))


UNMARKED_SQL = "select p_partkey, case when p_partkey % 3 = 0 then p_name || p_size::varchar else p_name end as name from part"


QUERIES = {
    "heard_words": heard_words, "heard_in_lines": heard_in_lines, "near_lines": near_lines, "line_chunks": line_chunks, "windowed_words": windowed_words,
    "validated_words": validated_words, "chart_timing": chart_timing, "score_pitches": score_pitches, "score_words": score_words,
    "score_lines": score_lines, "score_placement": score_placement, "score_charts": score_charts,
    "unheard_runs": unheard_runs, "spliced_words": spliced_words, "first_releases": first_releases, "unmarked_names": unmarked_names,
}
ORACLES = {
    "heard_words": HEARD_SQL, "heard_in_lines": HEARD_LINES_SQL, "near_lines": NEAR_SQL, "line_chunks": CHUNKS_SQL, "chart_timing": CHART_SQL,
    "score_pitches": SCORE_SQL, "score_words": SCORE_WORDS_SQL, "score_lines": SCORE_LINES_SQL,
    "unheard_runs": UNHEARD_SQL, "spliced_words": SPLICED_SQL, "first_releases": RELEASES_SQL, "unmarked_names": UNMARKED_SQL,
}
