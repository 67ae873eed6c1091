"""Queries of the placement operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoline.functions import scalars as S
from chronoline.operators import alignment as A
from chronoline.operators import calibration as K
from chronoline.operators import correlation as X
from chronoline.operators import placement as P
from chronoline.plans.estimator_queries import SECONDS, seconds
from chronoline.plans.sequence_queries import KEY, ORDER, UPTO, WIN
from chronoline.session import checkpoint, table
from chronoline.sources import charts as C

DAY = 86400.0


def text_slices(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    weights = F.array((F.col("p_size") % 5).cast("double"), (F.col("p_partkey") % 7).cast("double"), F.lit(2.0))
    return parts.select("p_partkey", F.array_join(P.slice_text(F.col("p_name"), weights), "|").alias("pieces"))


TEXT_SLICES_SQL = """
with w as (select p_partkey, p_name as t, length(p_name) as l, [(p_size % 5)::double, (p_partkey % 7)::double, 2.0::double] as w from part),
c as (select *, list_transform(range(0, 4), lambda i: coalesce(list_sum(w[1:i]), 0)) as cum from w),
r as (select *, list_transform(range(0, 4), lambda i: round_even(cum[i + 1] / cum[4] * l, 0)::bigint - i) as over from c),
b as (select *, list_transform(range(0, 4), lambda i: case when i = 3 then l else i + least(l - 3, list_max(over[1:i + 1])) end) as cut from r)
select p_partkey, case when l >= 3 then concat_ws('|', substring(t, cut[1] + 1, cut[2] - cut[1]), substring(t, cut[2] + 1, cut[3] - cut[2]), substring(t, cut[3] + 1, cut[4] - cut[3])) end as pieces from b"""


def span_slices(spark, sf_dir):
    weights = F.array((F.col("event_id") % 4).cast("double"), (F.col("event_id") % 3).cast("double"), F.lit(1.0))
    ends = seconds(spark, sf_dir).withColumn("e", P.slice_span(F.lit(0.0), F.col("value").cast("double"), weights))
    return ends.select("event_id", *[F.round(F.element_at("e", k), 6).alias(f"e{k}") for k in (1, 2, 3)])


SPAN_SLICES_SQL = """
with w as (select event_id, value::double as d, (event_id % 4)::double as a, (event_id % 3)::double as b from events),
x as (select *, d * (a / (a + b + 1)) as x1, d * ((a + b) / (a + b + 1)) as x2 from w),
y as (select *, greatest(1e-6, x1) as e1 from x), z as (select *, greatest(e1 + 1e-6, x2) as e2 from y)
select event_id, round(e1, 6) as e1, round(e2, 6) as e2, round(greatest(e2 + 1e-6, d), 6) as e3 from z"""


def line_seeds(spark, sf_dir):
    line = F.when(F.col("event_type") != "error", F.floor(F.col("s") / DAY).cast("long"))
    ev = seconds(spark, sf_dir).withColumns({"line_no": line, "line_start": line * F.lit(DAY), "e": F.col("s") + F.col("value"), "anchor": F.when(F.col("event_type") == "view", F.col("s"))})
    out = P.seed_line_starts(ev, KEY, ORDER, "line_no", "line_start", "s", "e", "anchor")
    return out.select("event_id", F.round("seed_start", 4).alias("seed_start"), F.round("seed_end", 4).alias("seed_end"))


LINE_SEEDS_SQL = f"""
with {SECONDS}, l as (select *, case when event_type <> 'error' then floor(s / {DAY})::bigint end as line_no, s + value as e from t),
f as (select *, line_no is not null and line_no is distinct from lag(line_no) {WIN} and event_type <> 'view' as seeds from l)
select event_id, round(case when seeds then line_no * {DAY} end, 4) as seed_start, round(case when seeds then line_no * {DAY} + greatest(0, e - s) end, 4) as seed_end from f"""


def first_line_override(spark, sf_dir):
    lines = seconds(spark, sf_dir).select("user_id", (F.row_number().over(Window.partitionBy(*KEY).orderBy(*ORDER)) - 1).alias("line_no"), (F.col("s") / 3600 + F.col("user_id")).alias("t"), "value")
    return P.override_first_line(lines.drop("value"), lines.withColumn("delta", F.col("value") / 500), KEY).select("user_id", "line_no", F.round("t", 5).alias("t"))


FIRST_LINE_SQL = f"""
with {SECONDS}, l as (select user_id, row_number() {WIN} - 1 as line_no, s / 3600 + user_id as t, value from t)
select user_id, line_no::int as line_no, round(case when line_no = 0 and abs(t - (t + value / 500)) > 0.5 then t + value / 500 else t end, 5) as t from l"""


def display_lines(spark, sf_dir):
    ev = seconds(spark, sf_dir).select(*KEY, *ORDER, F.when(F.col("event_type") == "error", "break").otherwise("syl").alias("kind"), F.col("event_type").alias("text"), F.col("event_type").isin("signup", "view").alias("is_word_start"))
    return P.line_texts(P.lines_of_entries(ev, KEY, ORDER), KEY, ORDER)


DISPLAY_SQL = f"""
with {SECONDS}, c as (select *, case when event_type = 'error' and lag(event_type) {WIN} <> 'error' then 1 else 0 end as closes from t),
n as (select *, sum(closes) {UPTO} as line_no from c), w as (select *, row_number() over (partition by user_id, line_no order by t_us, event_id) as k from n where event_type <> 'error')
select user_id, line_no::bigint as line_no, string_agg(case when k > 1 and event_type in ('signup', 'view') then ' ' else '' end || event_type, '' order by t_us, event_id) as line from w group by all"""


def note_entries(spark, sf_dir):
    ev = seconds(spark, sf_dir).select(*KEY, *ORDER, (F.col("s") / 3600).alias("a"), (F.col("s") / 3600 + F.col("value") / 500).alias("b"), F.floor(F.col("value") / 10).cast("long").alias("pitch"))
    out = P.notes_as_entries(ev, KEY, ORDER, "a", "b", "pitch")
    return out.select("event_id", "part", "kind", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "text", "note_type")


_NAMES = "[" + ", ".join(f"'{n}'" for n in S.NOTE_NAMES) + "]"
NOTE_ENTRIES_SQL = f"""
with {SECONDS}, n as (select user_id, t_us, event_id, s / 3600 as a, s / 3600 + value / 500 as b, floor(value / 10)::bigint as pitch from t), p as (select *, lag(b) {WIN} as prev from n)
select event_id, 1 as part, 'syl' as kind, round(a, 4) as start, round(b, 4) as "end", {_NAMES}[(pitch + 60) % 12 + 1] || (floor((pitch + 60) / 12.0)::bigint - 1)::varchar as text,
       case when b - a >= 0.6 then '*' else ':' end as note_type from p
union all select event_id, 0, 'break', round(prev, 4), round(a, 4), null, null from p where a - prev >= 0.35"""


def text_changes(spark, sf_dir):
    ev = seconds(spark, sf_dir).select(*KEY, *ORDER, F.col("s").alias("start"), (F.col("s") + F.col("value")).alias("end"), F.col("event_type").alias("text"))
    after = ev.where("event_id % 7 <> 0").withColumns({"text": F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.col("text")), "dropped": F.col("event_id") % 11 == 0})
    return P.changed_words(ev, after, KEY, ORDER).select("event_id", "text", "new_text")


TEXT_CHANGES_SQL = f"""
with {SECONDS}, b as (select user_id, t_us, event_id, s, s + value as e, event_type as text from t),
a as (select user_id, s, e, case when event_id % 5 = 0 then 'x' else text end as text, event_id % 11 = 0 as dropped, row_number() over (partition by user_id, s, e order by t_us desc, event_id desc) as k from b where event_id % 7 <> 0)
select event_id, b.text, case when not a.dropped then a.text end as new_text from b left join a on a.k = 1 and a.user_id = b.user_id and a.s = b.s and a.e = b.e
where a.text is null or a.dropped or a.text <> b.text"""


def reference_texts(spark, sf_dir):
    third = F.col("p_partkey") % 3
    words = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ")[0].alias("text"), F.when(third == 1, F.col("p_name")).when(third == 2, F.col("p_type")).alias("reference_text"))
    return P.apply_reference(words).select("p_partkey", "new_text", "replaced")


REFERENCE_SQL = """
with w as (select p_partkey, split_part(p_name, ' ', 1) as text, case p_partkey % 3 when 1 then p_name when 2 then p_type end as ref from part),
n as (select *, trim(lower(trim(text)), '.,!?"''') as a, trim(lower(trim(ref)), '.,!?"''') as b from w),
d as (select *, ref is not null and not (a <> '' and b <> '' and (contains(a, b) or contains(b, a))) as replaced from n)
select p_partkey, case when replaced then ref else text end as new_text, replaced from d"""


def best_windows(spark, sf_dir):
    seg = seconds(spark, sf_dir).select("event_id", (F.col("s") / 3600).alias("t1"), (F.col("s") / 3600 + F.col("value") / 25).alias("t2"), (F.col("event_id") % 100 / 100.0).alias("baseline"))
    scored = P.windows_of(seg, "t1", "t2").withColumn("score", (F.col("event_id") * 37 + F.col("window_no") * 11) % 100 / 100.0)
    out = P.best_windows(scored, ["event_id"], "t1", "t2", "baseline", "score")
    return out.select("event_id", F.round("new_start", 4).alias("new_start"), F.round("new_end", 4).alias("new_end"), "moved")


BEST_WINDOWS_SQL = f"""
with {SECONDS}, g as (select event_id, s / 3600 as t1, s / 3600 + value / 25 as t2, event_id % 100 / 100.0::double as baseline from t),
w as (select *, unnest(range(0, ceil(t2 - t1)::bigint)) as k from g where t2 - t1 >= 10), c as (select *, t1 + k as a, least(t1 + k + 10, t2) as b, (event_id * 37 + k * 11) % 100 / 100.0::double as score from w),
r as (select *, row_number() over (partition by event_id order by score desc, k) as n from c), m as (select *, score > baseline and score >= baseline + 0.1::double as moved from r where n = 1)
select event_id, round(case when moved then a else t1 end, 4) as new_start, round(case when moved then b else t2 end, 4) as new_end, moved from m"""


def sound_lags(spark, sf_dir):
    ev = seconds(spark, sf_dir).select((F.col("user_id") % 10).alias("song"), F.floor(F.col("t_us") / 3600000000).cast("long").alias("hour"), "event_type")
    track = lambda kind: ev.where(F.col("event_type") == kind).groupBy("song", "hour").agg(F.count("*").alias("level"))
    return P.best_lag(track("view"), track("purchase"), ["song"], "hour", "level", 24)


SOUND_LAGS_SQL = f"""
with {SECONDS}, h as (select user_id % 10 as song, floor(t_us / 3600000000)::bigint as hour, event_type, count(*) as level from t where event_type in ('view', 'purchase') group by all),
c as (select *, level * count(*) over (partition by song, event_type) - sum(level) over (partition by song, event_type) as c from h),
g as (select l.song, l.hour - r.hour as lag, sum(l.c * r.c) as score from c l join c r on l.song = r.song and l.event_type = 'view' and r.event_type = 'purchase' and abs(l.hour - r.hour) <= 24 group by all)
select song, lag::int as lag, score::bigint as score from (select *, row_number() over (partition by song order by score desc, lag) as k from g) where k = 1"""


OFFSET_LAG = 7200
#: Places of the tracks to a second of the query's offsets.
OFFSET_RATE = 50.0


def sound_offsets(spark, sf_dir):
    """Levels a minute, five days of lag on either side, by blocks of transforms."""
    ev = seconds(spark, sf_dir).select((F.col("user_id") % 10).alias("song"), F.floor(F.col("t_us") / 60000000).cast("long").alias("minute"), "event_type", F.round("value").cast("long").alias("level"))
    track = lambda kind: ev.where(F.col("event_type") == kind)
    found = X.best_lag_by_blocks(track("view"), track("purchase"), ["song"], "minute", "level", OFFSET_LAG, block=4096)
    return found.select("song", "lag", F.col("score").cast("long").alias("score"), X.offset_seconds(F.col("lag"), OFFSET_RATE).alias("offset_seconds"))


SOUND_OFFSETS_SQL = f"""
with {SECONDS}, h as (select user_id % 10 as song, floor(t_us / 60000000)::bigint as place, event_type, round(value)::bigint as level from t where event_type in ('view', 'purchase') and value is not null),
c as (select *, level * count(*) over (partition by song, event_type) - sum(level) over (partition by song, event_type) as c from h),
g as (select l.song, l.place - r.place as lag, sum(l.c * r.c) as score from c l join c r on l.song = r.song and l.event_type = 'view' and r.event_type = 'purchase' and abs(l.place - r.place) <= {OFFSET_LAG} group by all)
select song, lag, score::bigint as score, round(lag / {OFFSET_RATE}, 2) as offset_seconds from (select *, row_number() over (partition by song order by score desc, lag) as k from g) where k = 1"""


def placement_checks(spark, sf_dir):
    day = F.floor(F.col("s") / DAY).cast("long")
    ev = seconds(spark, sf_dir).withColumn("day", day)
    asked = F.count("*").over(Window.partitionBy("user_id", "day")) + F.when(F.col("day") % 5 == 0, 1).otherwise(0)
    ev = ev.withColumns({"asked": asked, "w0": F.col("day") * F.lit(DAY), "w1": (F.col("day") + 1) * F.lit(DAY), "e": F.col("s") + F.col("value") * 100})
    return P.placed_as_asked(ev, ["user_id", "day"], ORDER, "s", "e", "w0", "w1", "asked")


PLACEMENT_SQL = f"""
with {SECONDS}, d as (select *, floor(s / {DAY})::bigint as day from t)
select user_id, day, bool_and(s + value * 100 <= (day + 1) * {DAY} + 0.5) and day % 5 <> 0 and {DAY} >= 0.1 + 0.08 * count(*) as ok from d group by user_id, day"""


def still_media(spark, sf_dir):
    frames = seconds(spark, sf_dir).withColumn("pixels", F.array(F.col("value").cast("double"), (F.col("event_id") % 7).cast("double"), (F.col("t_us") % 5).cast("double")))
    return P.still_frames(frames, KEY, ORDER, "pixels", 250.0).select("user_id", F.round("difference", 6).alias("difference"), "still")


STILL_SQL = f"""
with {SECONDS}, f as (select *, row_number() {WIN} as n, first_value(value) {WIN} as v0, first_value(event_id % 7) {WIN} as m0, first_value(t_us % 5) {WIN} as u0 from t),
g as (select user_id, max(case when n > 1 then (abs(v0 - value) + abs(m0 - event_id % 7) + abs(u0 - t_us % 5)) / 3 end) as d from f group by user_id)
select user_id, round(d, 6) as difference, d <= 250.0 as still from g"""


def phase_report(spark, sf_dir):
    out = P.phase_report(seconds(spark, sf_dir), "event_type", "value", F.col("value") < 100)
    return out.select("event_type", "runs", "failed", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"))


PHASE_SQL = "select event_type, count(*) as runs, count(*) filter (where value < 100) as failed, round(sum(value), 2) as total, round(avg(value), 6) as mean from events group by event_type"


def class_offsets(spark, sf_dir):
    ours = F.floor(F.col("value") / 7).cast("long")
    other = F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 12).otherwise(F.col("event_id") % 12)
    ev = seconds(spark, sf_dir).withColumns({"ours": ours, "theirs": ours + 60 + other})
    return K.class_offset(ev, KEY, ORDER, "ours", "theirs", "value").select("user_id", "offset", F.round("share", 6).alias("share"))


CLASS_OFFSETS_SQL = f"""
with {SECONDS}, m as (select *, case when event_id % 3 = 0 then user_id % 12 else event_id % 12 end as b, row_number() over (partition by user_id order by value desc, t_us, event_id) as rk, count(*) over (partition by user_id) as n,
  row_number() {WIN} as seen from t),
v as (select user_id, b, n, count(*) as agree, min(seen) as first from m group by all), f as (select *, row_number() over (partition by user_id order by agree desc, first) as k from v),
hv as (select user_id, b, count(*) as agree, min(rk) as first from m where rk <= greatest(8, floor(n / 2.0)) group by all), hf as (select *, sum(agree) over (partition by user_id) as hn, row_number() over (partition by user_id order by agree desc, first) as k from hv),
j as (select f.user_id, f.n, f.b as b1, f.agree / f.n as s1, hf.b as b2, hf.agree / hf.hn as s2 from f join hf on f.user_id = hf.user_id and f.k = 1 and hf.k = 1)
select user_id, (case when n < 8 then null when s1 >= 0.5 then b1 when s2 >= 0.4 or s2 > s1 then b2 else b1 end)::bigint as "offset", round(case when n < 8 then 0.0 when s1 >= 0.5 then s1 when s2 >= 0.4 or s2 > s1 then s2 else s1 end::double, 6) as share from j"""


def assigned_lines(spark, sf_dir):
    """Words of each turn but every sixth, walked through the turn's own lines."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), "text")
    lines = checkpoint(C.parse_lyrics(c, "k", "text"))
    words = C.tokenize(lines, "k").where("pos % 6 <> 5").select("k", "pos", F.col("original").alias("text"), F.col("pos").cast("double").alias("start"), (F.col("pos") + 0.5).cast("double").alias("end"))
    return A.assign_lines(words, lines, "k").select("k", "pos", "new_text", "line_no")


QUERIES = {
    "text_slices": text_slices, "span_slices": span_slices, "line_seeds": line_seeds, "first_line_override": first_line_override, "display_lines": display_lines,
    "note_entries": note_entries, "text_changes": text_changes, "reference_texts": reference_texts, "best_windows": best_windows, "sound_lags": sound_lags,
    "sound_offsets": sound_offsets,
    "placement_checks": placement_checks, "still_media": still_media, "phase_report": phase_report, "class_offsets": class_offsets, "assigned_lines": assigned_lines,
}
ORACLES = {
    "text_slices": TEXT_SLICES_SQL, "span_slices": SPAN_SLICES_SQL, "line_seeds": LINE_SEEDS_SQL, "first_line_override": FIRST_LINE_SQL, "display_lines": DISPLAY_SQL,
    "note_entries": NOTE_ENTRIES_SQL, "text_changes": TEXT_CHANGES_SQL, "reference_texts": REFERENCE_SQL, "best_windows": BEST_WINDOWS_SQL, "sound_lags": SOUND_LAGS_SQL,
    "sound_offsets": SOUND_OFFSETS_SQL,
    "placement_checks": PLACEMENT_SQL, "still_media": STILL_SQL, "phase_report": PHASE_SQL, "class_offsets": CLASS_OFFSETS_SQL,
}
