"""Queries of the scalar and ordered-sequence operators on the driver's tables.

The tables hold no songs, so events stand for timed notes (user_id is the track, value the
pitch or weight) and parts for titles. Each query keeps its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoline.functions import scalars as S
from chronoline.operators import ordered as O
from chronoline.session import table

KEY, ORDER = ["user_id"], ["t_us", "event_id"]
GAP_US = 6 * 3600 * 1_000_000
BPM = 1.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t_us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", t_us.alias("t_us"))


EV = "ev as (select event_id, user_id, event_type, value, epoch_us(ts) as t_us from events)"
WIN = "over (partition by user_id order by t_us, event_id)"
PRE = "over (partition by user_id order by t_us, event_id rows between unbounded preceding and 1 preceding)"
UPTO = "over (partition by user_id order by t_us, event_id rows between unbounded preceding and current row)"
POST = "over (partition by user_id order by t_us, event_id rows between 1 following and unbounded following)"
ONWARD = "over (partition by user_id order by t_us, event_id rows between current row and unbounded following)"


def gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by gap, each with its span and its weighted-mode pitch (first seen on ties)."""
    grouped = O.gap_groups(events(spark, sf_dir), KEY, ORDER, "t_us", "t_us", GAP_US)
    voted = grouped.groupBy("user_id", "grp", F.bround(F.col("value") / 50).cast("long").alias("pitch")).agg(
        F.count("*").alias("n"), F.bround(F.sum("value"), 4).alias("w"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.min(F.struct(*ORDER)).alias("seen")
    )
    best = F.max_by("pitch", F.struct("w", -F.col("seen.t_us"), -F.col("seen.event_id")))
    return voted.groupBy("user_id", "grp").agg(F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), best.alias("mode_pitch"))


GAP_GROUPS_SQL = f"""
with {EV}, f as (select *, case when t_us - lag(t_us) {WIN} > {GAP_US} then 1 else 0 end as s from ev),
g as (select *, sum(s) {UPTO} as grp from f),
v as (select user_id, grp, round_even(value / 50, 0)::bigint as pitch, count(*) as n, round_even(sum(value), 4) as w,
             min(t_us) as first_us, max(t_us) as last_us, min(struct_pack(t := t_us, e := event_id)) as seen from g group by all),
r as (select *, row_number() over (partition by user_id, grp order by w desc, seen) as k from v)
select user_id, grp::bigint as grp, sum(n)::bigint as n, min(first_us) as first_us, max(last_us) as last_us, max(case when k = 1 then pitch end) as mode_pitch
from r group by user_id, grp"""


def _beats(spark, sf_dir):
    ev = events(spark, sf_dir)
    rel = (F.col("t_us") - F.min("t_us").over(Window.partitionBy(*KEY))) / 1e6
    return ev.withColumns({"beat": S.seconds_to_beat(rel, F.lit(0), F.lit(BPM)), "len": S.seconds_to_beats(F.col("value") * 100, F.lit(BPM))})


BEATS = f"""{EV}, b as (select *, round_even((t_us - min(t_us) over (partition by user_id)) / 1e6 * 1000.0 / 15000.0, 0)::bigint as beat,
  greatest(1, floor(value * 100 * 1000.0 / 15000.0))::bigint as len from ev)"""


def beat_quantize(spark, sf_dir):
    return O.quantize(_beats(spark, sf_dir), KEY, ORDER, "beat", "len").select("user_id", "event_id", "beat", "len", "start_beat")


BEAT_QUANTIZE_SQL = f"""
with {BEATS}, p as (select *, coalesce(sum(len) {PRE}, 0)::bigint as taken from b)
select user_id, event_id, beat, len, (taken + max(beat - taken) {UPTO})::bigint as start_beat from p"""


def quantize_with_breaks(spark, sf_dir):
    """Sign-ups stand for line breaks: they clamp but take no beats; -1 stands for no length or end."""
    entries = _beats(spark, sf_dir).withColumns({"kind": F.when(F.col("event_type") == "signup", "break").otherwise("syl"), "end_beat": F.col("beat") + F.col("len")})
    return O.quantize_entries(entries, KEY, ORDER).select(
        "user_id", "event_id", "kind", "start_beat", F.coalesce("out_len", F.lit(-1)).alias("out_len"), F.coalesce("out_end", F.lit(-1)).alias("out_end")
    )


QUANTIZE_BREAKS_SQL = f"""
with {BEATS}, k as (select *, case when event_type = 'signup' then 'break' else 'syl' end as kind, beat + len as end_beat from b),
p as (select *, coalesce(sum(case when kind = 'syl' then len else 0 end) {PRE}, 0)::bigint as taken from k),
m as (select *, max(case when kind = 'syl' then beat - taken end) {UPTO} as base from p),
s as (select *, (case when kind = 'syl' then taken + base else greatest(beat, coalesce(taken + base, beat)) end)::bigint as start_beat from m)
select user_id, event_id, kind, start_beat, case when kind = 'syl' then len else -1 end as out_len,
       case when kind = 'break' then greatest(end_beat, start_beat)::bigint else -1 end as out_end from s"""


def melisma_islands(spark, sf_dir):
    q = O.quantize(_beats(spark, sf_dir), KEY, ORDER, "beat", "len")
    q = q.withColumns({"text": F.when(F.col("event_type").isin("view", "click", "error"), "~").otherwise("la"), "pitch": F.floor(F.col("value") / 250).cast("long")})
    out = O.merge_tails(q, KEY, ORDER, "text", "pitch", "start_beat", "len")
    return out.select("user_id", "island", "text", "pitch", "start_beat", "len", "merged")


MELISMA_SQL = f"""
with {BEATS}, p as (select *, coalesce(sum(len) {PRE}, 0)::bigint as taken from b),
q as (select *, (taken + max(beat - taken) {UPTO})::bigint as start_beat,
      case when event_type in ('view', 'click', 'error') then '~' else 'la' end as text, floor(value / 250)::bigint as pitch from p),
j as (select *, case when text = '~' and pitch = lag(pitch) {WIN} and start_beat = lag(start_beat + len) {WIN} then 0 else 1 end as opens from q),
i as (select *, sum(case when lag_n = 0 then 0 else opens end) {UPTO} as island from (select *, row_number() {WIN} - 1 as lag_n from j))
select user_id, island::bigint as island, min_by(text, struct_pack(t_us, event_id)) as text, min_by(pitch, struct_pack(t_us, event_id)) as pitch,
       min_by(start_beat, struct_pack(t_us, event_id)) as start_beat, sum(len)::bigint as len, count(*) as merged
from i group by user_id, island"""


def padded_median(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("voiced", F.col("event_type") != "error")
    return O.padded_median(ev, KEY, ORDER, "value", "voiced", 5).select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


PADDED_MEDIAN_SQL = f"""
with {EV}, v as (select *, event_type <> 'error' as voiced from ev),
s as (select *, case when voiced is distinct from lag(voiced) {WIN} then 1 else 0 end as o from v),
r as (select *, sum(o) {UPTO} as run from s),
n as (select *, count(*) over (partition by user_id, run) as n, row_number() over (partition by user_id, run order by t_us, event_id) as i,
      list(value) over (partition by user_id, run order by t_us, event_id rows between unbounded preceding and unbounded following) as vs from r)
select user_id, event_id, round(case when voiced and n >= 3 then list_median(list_transform([i - 2, i - 1, i, i + 1, i + 2], lambda k: vs[least(greatest(k, 1), n)])) else value end, 6) as smooth from n"""


def _anchors(spark, sf_dir):
    """Errors are anchors: they moved by a drifting offset; seconds from a track's first event."""
    rel = (F.col("t_us") - F.min("t_us").over(Window.partitionBy(*KEY))) / 1e6
    ev = events(spark, sf_dir).withColumn("s", rel).withColumn("e", rel + F.col("value") * 10)
    moved = F.when(F.col("event_type") == "error", F.col("s") * 1.01 + 5.0)
    return ev.withColumns({"a": moved, "ae": moved + F.col("value") * 10})


def anchor_interpolate(spark, sf_dir):
    out = O.interpolate_anchors(_anchors(spark, sf_dir), KEY, ORDER, "s", "e", "a", "ae")
    return out.select("user_id", "event_id", "placed", F.round("new_start", 4).alias("new_start"), F.round("new_end", 4).alias("new_end"))


ANCHOR_SQL = f"""
with {EV}, t as (select *, (t_us - min(t_us) over (partition by user_id)) / 1e6 as s from ev),
a as (select *, s + value * 10 as e, case when event_type = 'error' then s * 1.01 + 5.0 end as a,
      case when event_type = 'error' then s end as old from t),
n as (select *, last_value(a ignore nulls) {PRE} as bn, last_value(old ignore nulls) {PRE} as bo,
      first_value(a ignore nulls) {POST} as an, first_value(old ignore nulls) {POST} as ao from a),
r as (select *, case when ao - bo > 1e-6 then (an - bn) / (ao - bo) end as rate, coalesce(bn - bo, an - ao) as shift from n),
p as (select *, case when a is not null then a when rate > 0 then bn + (s - bo) * rate when shift is not null then s + shift else s end as st,
      case when a is not null then a + value * 10 when rate > 0 then bn + (s - bo) * rate + (e - s) * rate when shift is not null then s + shift + (e - s) else e end as en,
      case when a is not null then 'anchor' when shift is not null then 'interpolated' else 'kept' end as placed,
      sum(case when a is not null then 1 else 0 end) {UPTO} as blk from r),
h as (select *, case when a is not null then st else max(st) over (partition by user_id, blk order by t_us, event_id) end as held from p),
f as (select *, case when a is not null then held else least(held, coalesce(an, held)) end as ns from h)
select user_id, event_id, placed, round(ns, 4) as new_start,
       round(greatest(least(en, coalesce(lead(ns) {WIN}, en)), ns), 4) as new_end from f"""


def class_fill(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("pc", F.when(F.col("event_type") != "error", F.pmod(F.floor("value"), F.lit(12)).cast("long")))
    return ev.select("user_id", "event_id", O.fill_forward("pc", KEY, ORDER).alias("pc"))


CLASS_FILL_SQL = f"""
with {EV}, p as (select *, case when event_type <> 'error' then floor(value)::bigint % 12 end as pc from ev)
select user_id, event_id, coalesce(last_value(pc ignore nulls) {UPTO}, first_value(pc ignore nulls) {ONWARD}) as pc from p"""


def monotone_anchors(spark, sf_dir):
    return O.monotone_anchors(events(spark, sf_dir), KEY, ORDER, "value").select("user_id", "event_id", "value")


MONOTONE_SQL = f"with {EV}, m as (select *, max(value) {PRE} as top from ev) select user_id, event_id, value from m where top is null or value >= top"


def enforce_monotonic(spark, sf_dir):
    ev = _anchors(spark, sf_dir).select("user_id", "t_us", "event_id", (F.col("s") / 1000).alias("s"), F.when(F.col("event_type") == "error", F.col("s") / 1000 - 1).otherwise(F.col("e") / 1000).alias("e"))
    out = O.enforce_monotonic(ev, KEY, ORDER, "s", "e")
    return out.select("user_id", "event_id", F.round("new_start", 6).alias("new_start"), F.round("new_end", 6).alias("new_end"))


MONOTONIC_SQL = f"""
with recursive {EV}, t as (select *, (t_us - min(t_us) over (partition by user_id)) / 1e6 as s0, row_number() {WIN} as i from ev),
x as (select user_id, event_id, i, s0 / 1000 as s, case when event_type = 'error' then s0 / 1000 - 1 else (s0 + value * 10) / 1000 end as e from t),
r as (select user_id, event_id, i, s as ns, case when e <= s then s + 0.06 else e end as ne from x where i = 1
  union all
  select x.user_id, x.event_id, x.i, case when x.s < r.ne + 0.01 then r.ne + 0.01 else x.s end as ns,
    case when x.e <= (case when x.s < r.ne + 0.01 then r.ne + 0.01 else x.s end) then (case when x.s < r.ne + 0.01 then r.ne + 0.01 else x.s end) + 0.06 else x.e end as ne
  from x join r on x.user_id = r.user_id and x.i = r.i + 1)
select user_id, event_id, round(ns, 6) as new_start, round(ne, 6) as new_end from r"""


def words_of_syllables(spark, sf_dir):
    ev = events(spark, sf_dir).withColumns({"ws": F.col("event_type").isin("signup", "purchase"), "syl": F.substring("event_type", 1, 2)})
    return O.collect_words(ev, KEY, ORDER, "ws", "syl", "t_us", "t_us").select("user_id", "word_id", "word", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


WORDS_SQL = f"""
with {EV}, f as (select *, case when row_number() {WIN} = 1 then 0 when event_type in ('signup', 'purchase') then 1 else 0 end as o from ev),
w as (select *, sum(o) {UPTO} as word_id from f)
select user_id, word_id::bigint as word_id, string_agg(substr(event_type, 1, 2), '' order by t_us, event_id) as word, min(t_us) as start_us, max(t_us) as end_us from w group by user_id, word_id"""


def longest_unanchored(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("sure", F.col("event_type") == "purchase")
    return O.longest_run(ev, KEY, ORDER, "sure", False)


LONGEST_SQL = f"""
with {EV}, c as (select *, sum(case when event_type = 'purchase' then 1 else 0 end) {UPTO} as g from ev)
select user_id, max(n)::bigint as longest from (select user_id, g, count(*) filter (where event_type <> 'purchase') as n from c group by user_id, g) group by user_id"""


def leading_slivers(spark, sf_dir):
    ev = O.gap_groups(events(spark, sf_dir), KEY, ORDER, "t_us", "t_us", GAP_US).withColumns({"a": F.lit(0.0), "b": F.col("value") / 1000, "keep": F.col("event_type") == "signup"})
    return O.drop_leading_slivers(ev, ["user_id", "grp"], ORDER, "a", "b", "keep").select("user_id", "grp", "event_id", "value")


SLIVERS_SQL = f"""
with {EV}, f as (select *, case when t_us - lag(t_us) {WIN} > {GAP_US} then 1 else 0 end as s from ev), g as (select *, sum(s) {UPTO} as grp from f),
l as (select *, min(case when value / 1000 < 0.12 and event_type <> 'signup' then 1 else 0 end) over (partition by user_id, grp order by t_us, event_id) as lead_,
      row_number() over (partition by user_id, grp order by t_us desc, event_id desc) as back from g)
select user_id, grp::bigint as grp, event_id, value from l where lead_ = 0 or back = 1"""


def break_positions(spark, sf_dir):
    ev = events(spark, sf_dir).withColumns({"kind": F.when(F.col("event_type") == "signup", "break").otherwise("syl"), "s": F.col("t_us"), "e": F.when(F.col("value") < 400, F.col("t_us") + 1_000_000)})
    ev = ev.withColumn("e", F.when(F.col("kind") == "syl", F.col("t_us") + 1_000_000).otherwise(F.col("e")))
    return O.reposition_breaks(ev, KEY, ORDER, "kind", "s", "e").where("kind = 'break'").select("user_id", "event_id", "new_start", "new_end")


BREAKS_SQL = f"""
with {EV}, k as (select *, event_type = 'signup' as brk, case when event_type <> 'signup' or value < 400 then t_us + 1000000 end as e from ev),
n as (select *, last_value(case when not brk then e end ignore nulls) {PRE} as pe, first_value(case when not brk then t_us end ignore nulls) {ONWARD} as ns from k)
select user_id, event_id, coalesce(pe, ns, t_us) as new_start, case when e is not null then coalesce(ns, pe, t_us) end as new_end from n where brk"""


def scalar_titles(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name, kind = F.col("p_name"), F.col("p_type")
    title = F.concat(F.col("p_brand"), F.lit(" - "), name, F.lit(" of the "), F.lower(kind), F.lit(" OK.. "))
    split = S.split_artist_title(title)
    return p.select(
        "p_partkey", S.normalize_word(title).alias("norm"), S.normalize_edges(title).alias("edges"), S.normalize_line(title).alias("line"),
        S.headline_case(title).alias("headline"), S.safe_file_name(title).alias("file_name"), split["artist"].alias("artist"), split["title"].alias("title"),
        S.loosely_equal(F.lower(kind), F.lower(title)).alias("loose"), S.without_fillers(S.normalize_line(title)).alias("flat"),
    )


_TITLE = "p_brand || ' - ' || p_name || ' of the ' || lower(p_type) || ' OK.. '"
SCALAR_TITLES_SQL = f"""
with p as (select *, {_TITLE} as t from part),
n as (select *, array_to_string(list_filter(list_transform(regexp_split_to_array(t, '\\s+'), lambda w: regexp_replace(lower(w), '[^a-z0-9'']', '', 'g')), lambda w: w <> ''), ' ') as line from p)
select p_partkey, regexp_replace(lower(t), '[^a-z0-9'']', '', 'g') as norm, trim(lower(trim(t)), '.,!?"''') as edges, line,
  array_to_string(list_transform(string_split(t, ' '), lambda w, i: case
     when regexp_replace(w, '[^\\p{{L}}]', '', 'g') = '' then w
     when length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) > 1 and regexp_replace(w, '[^\\p{{L}}]', '', 'g') = upper(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) then w
     when substr(regexp_replace(w, '[^\\p{{L}}]', '', 'g'), 2) <> lower(substr(regexp_replace(w, '[^\\p{{L}}]', '', 'g'), 2)) then w
     when i > 1 and i < len(string_split(t, ' ')) and regexp_replace(lower(w), '[^\\p{{L}}]', '', 'g') in ({', '.join(f"'{w}'" for w in S.MINOR_WORDS)}) then lower(w)
     else upper(substr(w, 1, 1)) || lower(substr(w, 2)) end), ' ') as headline,
  regexp_replace(regexp_replace(t, '[<>:"/\\\\|?*]', '', 'g'), '[ .]+$', '') as file_name,
  trim(split_part(t, ' - ', 1)) as artist, trim(substr(t, instr(t, ' - ') + 3)) as title,
  (contains(lower(t), lower(p_type)) or contains(lower(p_type), lower(t))) as loose,
  array_to_string(list_filter(string_split(line, ' '), lambda w: w not in ({', '.join(f"'{w}'" for w in S.FILLERS)})), '') as flat
from n"""


def scalar_music(spark, sf_dir):
    ev = events(spark, sf_dir)
    v = F.col("value")
    pitch = S.hz_to_pitch(v + 20)
    return ev.select(
        "event_id", pitch.cast("long").alias("pitch"), S.pitch_name(pitch).alias("name"), S.nearest_pitch_of_class(pitch, F.lit(3)).cast("long").alias("near"),
        F.round(S.fold_tempo(v), 6).alias("tempo"), S.note_type(v / 500).alias("kind"), S.cents_to_class(v * 12).cast("long").alias("pc"),
        S.format_tempo(v).alias("bpm_text"), F.round(S.beat_to_seconds(F.floor(v), F.lit(250), v + 1), 6).alias("sec"),
        F.bround(S.bit_rate_for_crf(F.lit(1280), F.lit(720), F.lit(25), v / 20), 2).alias("rate"),
        S.parse_clock(F.concat(F.floor(v / 60).cast("string"), F.lit(":"), F.lpad((F.floor(v) % 60).cast("string"), 2, "0"))).alias("clock"),
        F.array_join(S.chunks_of(F.array(*map(F.lit, "abcdefg")), (F.floor(v) % 7 + 1).cast("int")), "|").alias("chunks"),
    )


SCALAR_MUSIC_SQL = f"""
with {EV}, p as (select *, (round_even(69.0 + 12 * log2((value + 20) / 440.0), 0) - 60)::bigint as pitch from ev),
c as (select *, floor(value)::bigint % 7 + 1 as n from p)
select event_id, pitch, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][((pitch + 60) % 12 + 12) % 12 + 1] || (floor((pitch + 60) / 12.0) - 1)::bigint as name,
  pitch + case when ((3 - pitch) % 12 + 12) % 12 > 6 then ((3 - pitch) % 12 + 12) % 12 - 12 else ((3 - pitch) % 12 + 12) % 12 end as near,
  round(case when value < 60 then value * pow(2, ceil(log2(60.0 / value))) when value > 200 then value / pow(2, ceil(log2(value / 200.0))) else value end, 6) as tempo,
  case when value / 500 >= 0.6 then '*' else ':' end as kind,
  ((round_even(69.0 + 12 * log2(10 * pow(2, value * 12 / 1200) / 440.0), 0)::bigint % 12) + 12) % 12 as pc,
  regexp_replace(regexp_replace(format('{{:.2f}}', value), '0+$', ''), '\\.$', '') as bpm_text,
  round((250 + floor(value) * (60000.0 / ((value + 1) * 4))) / 1000.0, 6) as sec,
  round_even(0.1 * pow(2, (23 - value / 20) / 6.0) * 1280 * 720 * 25, 2) as rate, floor(value)::double as clock,
  array_to_string(list_transform(range(0, n), lambda k: substr('abcdefg', (k * (7 // n) + least(k, 7 % n) + 1)::bigint, (7 // n + case when k < 7 % n then 1 else 0 end)::bigint)), '|') as chunks
from c"""


def normalize_lines(spark, sf_dir):
    """Normalized lines of all documents and how often each occurs."""
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.explode(F.split("text", "\n")).alias("raw")).select(S.normalize_line(F.col("raw")).alias("line"))
    return lines.where("line <> ''").groupBy("line").agg(F.count("*").alias("n"))


NORMALIZE_LINES_SQL = r"""
with l as (select unnest(string_split(text, chr(10))) as t from documents),
n as (select array_to_string(list_filter(list_transform(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'),
  lambda w: regexp_replace(translate(lower(w), '’‘', ''''''), '[^a-z0-9'']', '', 'g')), lambda w: w <> ''), ' ') as line from l)
select line, count(*) as n from n where line <> '' group by line"""

QUERIES = {
    "gap_groups": gap_groups, "beat_quantize": beat_quantize, "quantize_with_breaks": quantize_with_breaks, "melisma_islands": melisma_islands,
    "padded_median": padded_median, "anchor_interpolate": anchor_interpolate, "class_fill": class_fill, "monotone_anchors": monotone_anchors,
    "enforce_monotonic": enforce_monotonic, "words_of_syllables": words_of_syllables, "longest_unanchored": longest_unanchored,
    "leading_slivers": leading_slivers, "break_positions": break_positions, "scalar_titles": scalar_titles, "scalar_music": scalar_music,
    "normalize_lines": normalize_lines,
}
ORACLES = {
    "gap_groups": GAP_GROUPS_SQL, "beat_quantize": BEAT_QUANTIZE_SQL, "quantize_with_breaks": QUANTIZE_BREAKS_SQL, "melisma_islands": MELISMA_SQL,
    "padded_median": PADDED_MEDIAN_SQL, "anchor_interpolate": ANCHOR_SQL, "class_fill": CLASS_FILL_SQL, "monotone_anchors": MONOTONE_SQL,
    "enforce_monotonic": MONOTONIC_SQL, "words_of_syllables": WORDS_SQL, "longest_unanchored": LONGEST_SQL, "leading_slivers": SLIVERS_SQL,
    "break_positions": BREAKS_SQL, "scalar_titles": SCALAR_TITLES_SQL, "scalar_music": SCALAR_MUSIC_SQL, "normalize_lines": NORMALIZE_LINES_SQL,
}
