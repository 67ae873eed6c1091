"""Queries of choices on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoline.operators import choices as X
from chronoline.plans.estimator_queries import SECONDS, seconds
from chronoline.plans.sequence_queries import KEY, ORDER, WIN
from chronoline.session import checkpoint, table
from chronoline.sources import charts as C


def _turns(spark, sf_dir):
    """Candidates of a conversation: the text up to each turn."""
    c = table(spark, sf_dir, "conversations")
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = c.groupBy("conv_id").agg(said.alias("said"))
    upto = F.transform("said", lambda x, i: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), F.array_join(F.transform(F.slice("said", 1, i + 1), lambda y: y["text"]), " ").alias("plain")))
    return whole.select("conv_id", F.explode(upto).alias("x")).select("conv_id", "x.*")


def chosen_lyrics(spark, sf_dir):
    """The whole conversation is the song; its beginnings are the candidates, every eleventh conversation has a forced one."""
    turns = _turns(spark, sf_dir)
    songs = turns.groupBy("conv_id").agg(F.max_by("plain", "turn").alias("plain"))
    songs = songs.select("conv_id", F.when(F.col("conv_id") % 3 == 0, "User").otherwise("nobody").alias("artist"), (F.lit(100.0) + F.col("conv_id") % 20).alias("seconds"), X.words_of(F.col("plain")).alias("words"))
    synced = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "").when((F.col("conv_id") + F.col("turn")) % 7 == 0, "untimed").otherwise(F.concat(F.lit("[01:4"), (F.col("turn") % 8).cast("string"), F.lit(".5]x")))
    candidates = turns.select(
        "conv_id", F.col("turn").alias("pos"), F.lit("t").alias("track_name"), F.col("role").alias("artist_name"), F.when(F.col("turn") != 3, F.lit(95.0) + F.col("turn") * 6 % 35).alias("duration"),
        ((F.col("conv_id") + F.col("turn")) % 9 == 0).alias("instrumental"), F.when(F.col("turn") % 4 != 2, F.col("plain")).alias("plain_lyrics"), synced.alias("synced_lyrics"),
        ((F.col("conv_id") % 11 == 0) & (F.col("turn") == 1)).alias("pinned"),
    )
    out = X.choose_lyrics(candidates, songs, "conv_id", "pinned")
    return out.select("conv_id", F.col("pos").cast("long").alias("pos"), F.round("ratio", 6).alias("ratio"), F.coalesce(F.round("gap", 6), F.lit(-1.0)).alias("gap"), "forced")


CHOSEN_SQL = r"""
with w as (select conv_id, turn, role, len(list_filter(list_transform(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\s+'),
    lambda x: regexp_replace(translate(lower(x), '’‘', ''''''), '[^a-z0-9'']', '', 'g')), lambda x: x <> '')) as n from conversations),
c as (select *, sum(n) over (partition by conv_id order by turn) as m, sum(n) over (partition by conv_id) as total, 100.0 + conv_id % 20 as seconds, case when conv_id % 3 = 0 then 'user' else 'nobody' end as artist,
    case when turn <> 3 then 95.0 + turn * 6 % 35 end::double as duration, (conv_id + turn) % 5 = 0 as bare, (conv_id + turn) % 5 <> 0 and (conv_id + turn) % 7 <> 0 as timed, 100.5 + turn % 8 as last from w),
e as (select *, case when timed and last >= duration then last else duration end as eff, case when turn % 4 <> 2 then m else 0 end as mine,
    contains(role, artist) or contains(artist, role) as same, conv_id % 11 = 0 and turn = 1 as pinned,
    row_number() over (partition by conv_id, role, duration order by turn) as again from c),
g as (select *, abs(eff - seconds) as gap, case when mine = 0 then 0.0 else 2.0 * mine / (mine + total) end as ratio from e),
o as (select *, max(pinned) over (partition by conv_id) as any_pinned, again = 1 and (conv_id + turn) % 9 <> 0 and not bare and duration is not null and gap <= 15 and mine > 0 and ratio >= 0.3 as fits from g),
r as (select *, row_number() over (partition by conv_id order by same desc, gap nulls last, ratio desc, turn) as k from o where case when any_pinned then pinned else fits end)
select conv_id, turn::bigint as pos, round(ratio, 6) as ratio, coalesce(round(gap, 6), -1) as gap, pinned as forced from r where k = 1 and timed"""


def tried_scores(spark, sf_dir):
    """Line items as tries of an order."""
    li = table(spark, sf_dir, "lineitem").withColumn("at", F.row_number().over(X.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    out = X.first_success(li.withColumn("done", F.col("l_quantity") > 40), "l_orderkey", "at", "done")
    return out.select("l_orderkey", F.col("at").cast("long").alias("at"), "done")


TRIED_SQL = """
with t as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k, l_quantity > 40 as done from lineitem),
r as (select *, row_number() over (partition by l_orderkey order by not done, case when done then k else -k end) as r from t)
select l_orderkey, k as "at", done from r where r = 1"""


def score_pitch_classes(spark, sf_dir):
    """Events as a score's syllables: predicted classes lie the user's number lower, but for every third."""
    pitch = F.floor(F.col("value") / 7).cast("long")
    wrong = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 12).otherwise(F.col("user_id") % 12)
    ev = seconds(spark, sf_dir).withColumns({"pitch": pitch, "pc": F.when(F.col("event_id") % 10 != 9, F.pmod(pitch + 60 - wrong, F.lit(12))), "c": F.col("value") % 1})
    out = X.calibrate_score_pitches(ev, "user_id", ["t_us", "event_id"], "pitch", "c", "pc")
    return out.select("user_id", "event_id", "pitch", "new_pitch", F.coalesce("offset", F.lit(-1)).alias("offset"), F.round("new_confidence", 6).alias("confidence"))


SCORE_PITCH_SQL = f"""
with {SECONDS}, s as (select *, floor(value / 7)::bigint as pitch, case when event_id % 3 = 0 then event_id % 12 else user_id % 12 end as d, value % 1 as c from t),
m as (select *, row_number() over (partition by user_id order by c desc, t_us, event_id) as rk, count(*) over (partition by user_id) as n, row_number() {WIN} as seen from s where event_id % 10 <> 9),
v as (select user_id, d, n, count(*) as agree, min(seen) as first from m group by all), f as (select *, row_number() over (partition by user_id order by agree desc, first) as k from v),
hv as (select user_id, d, count(*) as agree, min(rk) as first from m where rk <= greatest(8, floor(n / 2.0)) group by all),
hf as (select *, sum(agree) over (partition by user_id) as hn, row_number() over (partition by user_id order by agree desc, first) as k from hv),
j as (select f.user_id, f.n, f.d as b1, f.agree / f.n as s1, hf.d as b2, hf.agree / hf.hn as s2 from f join hf on f.user_id = hf.user_id and f.k = 1 and hf.k = 1),
o as (select user_id, case when n < 8 then null when s1 >= 0.5 then b1 when s2 >= 0.4 or s2 > s1 then b2 else b1 end as off from j),
u as (select s.*, off, (((pitch + 60 - off) % 12 - pitch) % 12 + 12) % 12 as up from s left join o using (user_id)),
x as (select *, coalesce(pitch + case when up > 6 then up - 12 else up end, pitch) as new_pitch from u)
select user_id, event_id, pitch, new_pitch::bigint as new_pitch, coalesce(off, -1)::bigint as "offset", round(case when new_pitch <> pitch then greatest(c, 0.75) else c end, 6) as confidence from x"""


def verified_files(spark, sf_dir):
    """Orders as backups, their line items as measurements of the current files."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rate = F.when(F.col("o_custkey") % 13 == 0, 0).otherwise(44100)
    backups = o.select(F.col("o_orderkey").alias("path_key"), rate.alias("sample_rate"), (F.col("o_custkey") % 2 + 1).alias("channels"), (F.col("o_custkey") / 10).alias("duration"))
    sums = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_tax"), 4).alias("tax"), F.round(F.sum("l_discount"), 4).alias("discount"))
    current = sums.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("path_key"), F.when(F.col("n") == 5, 48000).otherwise(44100).alias("sample_rate"), F.when(F.col("n") == 6, 1).otherwise(F.col("o_custkey") % 2 + 1).alias("channels"),
        F.when(F.col("n") != 7, F.col("o_custkey") / 10 + F.col("tax") / 2).alias("duration"), (F.lit(-14.3) + F.col("tax") * 8).alias("lufs"), (F.lit(-2.0) + F.col("discount") * 8).alias("true_peak"),
    )
    found = X.verification_issues(backups, current)
    return found.select("path_key", "verdict", F.array_join("issues", "; ").alias("issues"))


VERIFIED_SQL = """
with s as (select l_orderkey, count(*) as n, round(sum(l_tax), 4) as tax, round(sum(l_discount), 4) as discount from lineitem group by l_orderkey),
j as (select o_orderkey as path_key, o_custkey, n, tax, -14.3 + tax * 8 as lufs, -2.0 + discount * 8 as peak from orders left join s on o_orderkey = l_orderkey),
f as (select *, n <> 7 and lufs between -70 and 0 and peak between -99 and 9 as loud from j),
i as (select path_key, n, concat_ws('; ', case when n = 5 and o_custkey % 13 <> 0 then 'sample rate changed' end, case when n = 6 and o_custkey % 2 = 1 then 'channel count changed' end,
   case when n <> 7 and abs(o_custkey / 10 - (o_custkey / 10 + tax / 2)) > 0.05 then 'decoded duration differs' end, case when loud and abs(lufs - -14.0) > 1.0 then 'loudness off target' end,
   case when loud and peak > -0.5 then 'true peak exceeds ceiling' end, case when not loud then 'could not be measured' end) as issues from f)
select path_key, case when n is null then 'missing' when issues <> '' then 'issue' else 'ok' end as verdict, case when n is null then '' else issues end as issues from i"""


def aligned_by_trust(spark, sf_dir):
    """Words of each turn but every sixth, against the turn's own lines; every second conversation keeps time."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), "conv_id", "text")
    lines = checkpoint(C.parse_lyrics(c, "k", "text"))
    tokens = checkpoint(C.tokenize(lines, "k"))
    words = tokens.where("pos % 6 <> 5").select("k", "pos", F.col("original").alias("text"), F.col("pos").cast("double").alias("start"), (F.col("pos") + 0.5).cast("double").alias("end"))
    tracking = c.select("k", (F.col("conv_id") % 2 == 0).alias("tracks"))
    out = X.align_by_trust(words, tokens, lines, tracking, "k")
    return out.groupBy("k", "by").agg(F.count("*").alias("words"), F.count("reference_text").alias("referenced"), F.count("line_no").alias("lined"), F.count_if("dropped").alias("dropped"))


QUERIES = {"chosen_lyrics": chosen_lyrics, "tried_scores": tried_scores, "score_pitch_classes": score_pitch_classes, "verified_files": verified_files, "aligned_by_trust": aligned_by_trust}
ORACLES = {"chosen_lyrics": CHOSEN_SQL, "tried_scores": TRIED_SQL, "score_pitch_classes": SCORE_PITCH_SQL, "verified_files": VERIFIED_SQL}
