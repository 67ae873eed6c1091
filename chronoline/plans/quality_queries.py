"""Queries of quality records, lyric candidates, listings and media decisions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoline.functions import scalars as S
from chronoline.operators import ordered as O
from chronoline.operators import quality as Q
from chronoline.plans.estimator_queries import SECONDS, seconds
from chronoline.plans.sequence_queries import KEY, ORDER, WIN
from chronoline.session import table
from chronoline.sources import charts as C
from chronoline.sources import listings as L

_KINDS = {"click": "asr", "view": "lrc", "signup": "interpolated"}


def _words(spark, sf_dir):
    """Events as placed words: the type is the kind of place."""
    kind = F.coalesce(*[F.when(F.col("event_type") == t, k) for t, k in _KINDS.items()], F.lit("original"))
    return seconds(spark, sf_dir).withColumn("kind", kind)


WORDS = f"""{SECONDS}, wd as (select *, case event_type when 'click' then 'asr' when 'view' then 'lrc' when 'signup' then 'interpolated' else 'original' end as kind from t)"""


def realign_records(spark, sf_dir):
    got = Q.realign_quality(_words(spark, sf_dir), KEY, ORDER, "kind")
    why = F.coalesce(Q.retry_reason(F.col("anchor_rate"), F.col("longest_unanchored")), F.lit(""))
    return got.select("user_id", "n_words", "n_asr", "n_lrc", "n_forced", "n_interpolated", "n_kept", F.round("anchor_rate", 6).alias("anchor_rate"), "longest_unanchored", why.alias("retry"))


REALIGN_SQL = f"""
with {WORDS}, a as (select *, kind in ('asr', 'lrc', 'forced') as ok from wd),
r as (select *, row_number() {WIN} - row_number() over (partition by user_id, ok order by t_us, event_id) as run from a),
n as (select user_id, max(n) as longest from (select user_id, run, ok, case when ok then 0 else count(*) end as n from r group by user_id, run, ok) group by user_id),
c as (select user_id, count(*) as n_words, count(*) filter (where kind = 'asr') as n_asr, count(*) filter (where kind = 'lrc') as n_lrc, count(*) filter (where kind = 'forced') as n_forced,
  count(*) filter (where kind = 'interpolated') as n_interpolated, count(*) filter (where kind = 'original') as n_kept from a group by user_id)
select c.*, round((n_asr + n_lrc + n_forced) / n_words::double, 6) as anchor_rate, longest::bigint as longest_unanchored,
  case when (n_asr + n_lrc + n_forced) / n_words::double < 0.5 then 'rate' when longest >= 5 then 'run' else '' end as retry from c join n using (user_id)"""


def retry_choices(spark, sf_dir):
    """Two hearings of each track: the second takes dear purchases for anchors."""
    first = Q.realign_quality(_words(spark, sf_dir), KEY, ORDER, "kind").select("user_id", F.col("anchor_rate").alias("rate"), F.col("longest_unanchored").alias("run"))
    heard = _words(spark, sf_dir).withColumn("kind", F.when(F.col("value") % 7 < 2, "interpolated").when(F.col("value") % 7 > 5, "forced").otherwise(F.col("kind")))
    second = Q.realign_quality(heard, KEY, ORDER, "kind").select("user_id", F.col("anchor_rate").alias("new_rate"), F.col("longest_unanchored").alias("new_run"))
    better = Q.retry_is_better(F.col("rate"), F.col("run"), F.col("new_rate"), F.col("new_run"))
    return first.join(second, "user_id").select("user_id", F.round("new_rate", 6).alias("new_rate"), "new_run", better.alias("better"))


RETRY_SQL = f"""
with {WORDS}, b as (select *, 1 as hearing from wd union all select * replace (case when value % 7 < 2 then 'interpolated' when value % 7 > 5 then 'forced' else kind end as kind), 2 from wd),
a as (select *, kind in ('asr', 'lrc', 'forced') as ok from b),
r as (select *, row_number() over (partition by hearing, user_id order by t_us, event_id) - row_number() over (partition by hearing, user_id, ok order by t_us, event_id) as run from a),
n as (select hearing, user_id, max(n) as run from (select hearing, user_id, run, ok, case when ok then 0 else count(*) end as n from r group by hearing, user_id, run, ok) group by hearing, user_id),
c as (select hearing, user_id, avg(ok::int) as rate from a group by all),
q as (select * from c join n using (hearing, user_id))
select x.user_id, round(y.rate, 6) as new_rate, y.run::bigint as new_run, y.rate > x.rate or y.run < x.run as better from q x join q y on x.user_id = y.user_id and x.hearing = 1 and y.hearing = 2"""


def placement_records(spark, sf_dir):
    """A word's claimed start is its second less its value; clicks and views are placed."""
    words = seconds(spark, sf_dir).withColumns({"placed": F.col("event_type").isin("click", "view"), "claimed": F.col("s") - F.col("value") * 100})
    return Q.placement_quality(words, KEY, ORDER, "placed", "claimed").withColumn("placement_rate", F.round("placement_rate", 6))


PLACEMENT_SQL = f"""
with {SECONDS}, w as (select *, event_type in ('click', 'view') as placed, s - value * 100 as claimed from t),
m as (select *, claimed < max(claimed) over (partition by user_id order by t_us, event_id rows between unbounded preceding and 1 preceding) as late from w)
select user_id, count(*) as n_words, count(*) filter (where placed) as n_placed, count(*) filter (where not placed) as n_fallback,
  count(*) filter (where late) as n_moved, round(count(*) filter (where placed) / count(*)::double, 6) as placement_rate from m group by user_id"""


def alignment_records(spark, sf_dir):
    """Notes and syllables of a word from its value."""
    words = seconds(spark, sf_dir).withColumns({"notes": F.floor(F.col("value")) % 4, "syllables": F.floor(F.col("value") / 4) % 4})
    return Q.alignment_stats(words, KEY, "notes", "syllables")


ALIGNMENT_SQL = f"""
with {SECONDS}, w as (select *, floor(value)::bigint % 4 as n, floor(value / 4)::bigint % 4 as y from t)
select user_id, count(*) as total_words, count(*) filter (where n > 0) as words_with_notes, count(*) filter (where n = 0) as words_with_fallback,
  count(*) filter (where n > 0 and y < n) as words_with_melisma, count(*) filter (where n > 0 and y > n) as words_with_syllable_merge, sum(n)::bigint as total_notes from w group by user_id"""


def mean_scores(spark, sf_dir):
    """Whole values of purchases as scores, so that sums are exact in any order."""
    score = F.when(F.col("event_type") == "purchase", F.floor("value"))
    return seconds(spark, sf_dir).groupBy("user_id").agg(F.round(Q.mean_score(score), 6).alias("mean_score"))


MEAN_SQL = f"with {SECONDS} select user_id, round(coalesce(avg(floor(value)) filter (where event_type = 'purchase'), 0), 6) as mean_score from t group by user_id"


def window_words(spark, sf_dir):
    """Events within half a second of the days after each user's first sign-up."""
    ev = seconds(spark, sf_dir)
    own = ev.where("event_type = 'signup'").groupBy("user_id").agg(F.min("s").alias("low"))
    near = ev.join(own, "user_id").where(Q.in_window(F.col("s"), F.col("low"), F.col("low") + 5 * 86400.0))
    return near.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("least"))


WINDOW_SQL = f"""
with {SECONDS}, o as (select user_id, min(s) as low from t where event_type = 'signup' group by user_id)
select user_id, count(*) as n, min(event_id) as least from t join o using (user_id) where s between low - 0.5 and low + 5 * 86400.0 + 0.5 group by user_id"""


def word_chunks(spark, sf_dir):
    return Q.line_chunks(seconds(spark, sf_dir), KEY, ORDER, "event_type")


CHUNKS_SQL = f"""
with {SECONDS}, p as (select *, row_number() {WIN} - 1 as idx, lag(event_type) {WIN} as was from t),
g as (select *, sum(case when idx > 0 and was is distinct from event_type then 1 else 0 end) over (partition by user_id order by t_us, event_id) as chunk from p)
select user_id, chunk::bigint as chunk, min(idx)::bigint as first, max(idx)::bigint + 1 as stop from g group by user_id, chunk"""


def earliest_releases(spark, sf_dir):
    """Orders as releases of a customer; open ones have no date."""
    releases = table(spark, sf_dir, "orders").withColumn("dated", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")))
    return Q.earliest_release(releases, ["o_custkey"], "o_orderkey", "dated", "o_orderkey")


RELEASES_SQL = """
with r as (select *, case when o_orderstatus <> 'O' then o_orderdate end as dated from orders)
select o_custkey, coalesce(arg_min(o_orderkey, (dated, o_orderkey)) filter (where dated is not null), min(o_orderkey)) as o_orderkey from r group by o_custkey"""


def plain_titles(spark, sf_dir):
    title = F.concat("p_name", F.when(F.col("p_size") % 5 == 0, " [DUET]").otherwise(""), F.when(F.col("p_size") % 10 == 0, " [VIDEO]").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", Q.without_duet(title).alias("title"))


TITLES_SQL = "select p_partkey, p_name || case when p_size % 10 = 0 then ' [VIDEO]' else '' end as title from part"


def candidate_scores(spark, sf_dir):
    """Parts as lyric candidates: the size is the claimed minute, the key decides what lyrics there are."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", (F.col("p_partkey") % 6).alias("m"), (F.col("p_size") * 6.0).alias("claimed"))
    plain, synced = F.when(F.col("m") > 0, F.col("p_name")), F.when(F.col("m") > 1, F.col("p_name"))
    last = F.when(F.col("m") != 3, F.col("p_partkey") % 301)
    wanted = F.lit(150.0)
    duration = S.effective_duration(F.when(F.col("m") < 5, F.col("claimed")), synced, last.cast("double"))
    return p.select(
        "p_partkey", F.round(F.coalesce(duration, F.lit(-1.0)), 3).alias("duration"), F.round(S.candidate_score(F.col("m") == 4, plain, synced, duration, wanted), 6).alias("score"),
        S.artist_matches(F.col("p_brand"), F.concat(F.lower("p_brand"), F.when(F.col("m") == 1, "!").when(F.col("m") == 2, " feat. x").otherwise("7"))).alias("same_artist"),
    )


CANDIDATE_SQL = """
with p as (select p_partkey, p_brand, p_partkey % 6 as m, p_size * 6.0 as claimed, case when p_partkey % 6 > 1 then 1 end as synced, case when p_partkey % 6 <> 3 then (p_partkey % 301)::double end as last from part),
d as (select *, case when m < 5 and synced is not null and last >= claimed then last when m < 5 then claimed end as duration from p),
n as (select *, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') as ours from d),
t as (select *, ours || case m when 1 then '' when 2 then 'featx' else '7' end as theirs from n)
select p_partkey, round(coalesce(duration, -1), 3)::double as duration,
  round(case when m = 4 or m < 2 then -1 when duration <> 0 then greatest(0, 1 - abs(duration - 150) / 60.0) else 0 end, 6)::double as score,
  ours <> '' and (contains(ours, theirs) or contains(theirs, ours)) as same_artist from t"""


def media_checks(spark, sf_dir):
    """Line items as converted files: quantity is the size, prices stand for duration and loudness."""
    li = table(spark, sf_dir, "lineitem")
    size, width = F.floor(F.col("l_quantity")) % 7, F.col("l_linenumber") % 6
    problem = L.conversion_problem(size, width, width + 1, F.col("l_extendedprice") / 100, F.col("l_extendedprice") / 100 + F.col("l_discount") * 40, F.col("l_returnflag") == "N", F.col("l_linestatus") == "O")
    loud = L.loudness_plausible(F.lit(5.0) - F.col("l_quantity") * 2, F.col("l_tax") * 120)
    keyed = li.select("l_orderkey", "l_linenumber", F.coalesce(problem, F.lit("")).alias("problem"), loud.alias("loudness"))
    return keyed.groupBy("problem", "loudness").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("least"))


MEDIA_SQL = """
with m as (select l_orderkey, floor(l_quantity)::bigint % 7 as size, l_linenumber % 6 as width, l_extendedprice / 100 as d, l_extendedprice / 100 + l_discount * 40 as o,
  l_returnflag = 'N' as has, l_linestatus = 'O' as had, 5.0 - l_quantity * 2 as lufs, l_tax * 120 as peak from lineitem),
c as (select l_orderkey, case when size <= 0 then 'empty file' when width <= 0 then 'no picture' when abs(d - o) > greatest(1.0, o * 0.02) then 'duration differs'
  when had and not has then 'audio lost' else '' end as problem, lufs between -70 and 0 and peak between -99 and 9 as loudness from m)
select problem, loudness, count(*) as n, min(l_orderkey) as least from c group by problem, loudness"""


def path_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = F.concat(F.when(F.col("p_size") % 3 == 0, "C:\\").when(F.col("p_size") % 3 == 1, "d:/").otherwise("/"), F.col("p_brand"), F.lit("\\"), F.col("p_name"))
    head = F.unhex(F.when(F.col("p_size") % 4 == 0, "FFD8FFE0").when(F.col("p_size") % 4 == 1, "89504E470D0A1A0A00").when(F.col("p_size") % 4 == 2, "47494638"))
    return p.select("p_partkey", S.path_key(path).alias("key"), F.coalesce(S.image_kind(head), F.lit("")).alias("image"))


PATHS_SQL = r"""
select p_partkey, case p_size % 3 when 2 then '/' else '' end || p_brand || '/' || p_name as key,
  case p_size % 4 when 0 then '.jpg' when 1 then '.png' else '' end as image from part"""


def report_entries(spark, sf_dir):
    """Turns of conversations as the lines of a report."""
    head = F.when(F.col("turn") % 5 == 1, "ERROR: ").when(F.col("turn") % 5 == 2, "  ").when(F.col("turn") % 5 == 3, "No videos in ").otherwise("")
    line = F.concat(head, F.element_at(F.split("text", "\n"), 1), F.lit(" \t"))
    rows = L.report_paths(table(spark, sf_dir, "conversations").select(line.alias("value")))
    return rows.groupBy(F.md5("path").alias("path_md5")).agg(F.count("*").alias("n"))


REPORT_SQL = r"""
with l as (select case turn % 5 when 1 then 'ERROR: ' when 2 then '  ' when 3 then 'No videos in ' else '' end || string_split(text, chr(10))[1] || ' ' || chr(9) as raw from conversations),
p as (select rtrim(regexp_replace(raw, '\s+$', '')) as path from l)
select md5(path) as path_md5, count(*) as n from p where path <> '' and not regexp_matches(path, '^([ \t]|ERROR:|No videos)') group by path"""


def tagged_lyrics(spark, sf_dir):
    """Lines of documents with one stamp or two, under a title tag."""
    d = table(spark, sf_dir, "documents")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    stamp = lambda m, s, f: F.concat(F.lit("["), two(m), F.lit(":"), two(s), F.lit("."), two(f), F.lit("]"))
    body = F.transform(F.split("text", "\n"), lambda x, i: F.concat(stamp(i % 60, i * 7 % 60, i * 3 % 100), F.when(i % 3 == 0, stamp(i % 50 + 3, i * 11 % 60, i * 9 % 100)).otherwise(""), F.md5(x)))
    lyrics = d.select("doc_id", F.array_join(F.concat(F.array(F.concat(F.lit("[ti: no "), F.col("doc_id").cast("string"), F.lit(" ]"))), body), "\n").alias("lrc"))
    return C.parse_tagged_lyrics(lyrics, "doc_id", "lrc").select("doc_id", "title", F.md5("synced").alias("synced_md5"), F.md5("plain").alias("plain_md5"))


TAGGED_SQL = """
with l as (select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as i, md5(unnest(string_split(coalesce(text, ''), chr(10)))) as line from documents where text is not null),
s as (select doc_id, i, 0 as nth, line, (i % 60) * 60000 + (i * 7 % 60) * 1000 + (i * 3 % 100) * 10 as ms from l
  union all select doc_id, i, 1, line, (i % 50 + 3) * 60000 + (i * 11 % 60) * 1000 + (i * 9 % 100) * 10 from l where i % 3 = 0),
r as (select *, '[' || lpad((ms // 60000)::varchar, 2, '0') || ':' || lpad((ms % 60000 // 1000)::varchar, 2, '0') || '.' || lpad((ms % 1000 // 10)::varchar, 2, '0') || ']' || line as shown from s)
select doc_id, 'no ' || doc_id as title, md5(string_agg(shown, chr(10) order by ms, i, nth)) as synced_md5, md5(string_agg(line, chr(10) order by ms, i, nth)) as plain_md5 from r group by doc_id"""


def spread_syllables(spark, sf_dir):
    """Runs of one event type are words; each moves to [low + 1, high * 1.5 + 2]."""
    runs = O.islands(seconds(spark, sf_dir), KEY, ORDER, F.col("event_type") != F.lag("event_type").over(O.over(KEY, ORDER)), "word")
    word = Window.partitionBy("user_id", "word")
    own = runs.withColumns({"low": F.min("s").over(word), "high": F.max("s").over(word), "k": F.row_number().over(word.orderBy(*ORDER)) - 1, "n": F.count("*").over(word)})
    moved = O.spread_in_word(F.col("s"), F.col("s"), F.col("low"), F.col("high"), F.col("low") + 1, F.col("high") * 1.5 + 2, F.col("k"), F.col("n"))
    return own.withColumn("m", moved).select("event_id", F.round("m.start", 3).alias("new_start"), F.round("m.end", 3).alias("new_end"))


SPREAD_SQL = f"""
with {SECONDS}, p as (select *, case when lag(event_type) {WIN} <> event_type then 1 else 0 end as c from t),
g as (select *, sum(c) over (partition by user_id order by t_us, event_id) as word from p),
o as (select *, min(s) over (partition by user_id, word) as low, max(s) over (partition by user_id, word) as high,
  row_number() over (partition by user_id, word order by t_us, event_id) - 1 as k, count(*) over (partition by user_id, word) as n from g),
b as (select *, low + 1 as nl, high * 1.5 + 2 as nh from o)
select event_id, round(case when high > low then nl + (s - low) / (high - low) * (nh - nl) else nl + k * (nh - nl) / n end, 3) as new_start,
  round(case when high > low then nl + (s - low) / (high - low) * (nh - nl) else nl + (k + 1) * (nh - nl) / n end, 3) as new_end from b"""


def batch_results(spark, sf_dir):
    """Customers as songs of a nation's folder: a negative balance is a failure."""
    results = table(spark, sf_dir, "customer").withColumn("problem", F.when(F.col("c_acctbal") < 0, F.concat(F.lit("overdrawn "), F.col("c_mktsegment"))))
    return Q.batch_summary(results, ["c_nationkey"], "problem").withColumn("first_problem", F.coalesce("first_problem", F.lit("")))


BATCH_SQL = """
select c_nationkey, count(*) filter (where c_acctbal >= 0) as n_ok, count(*) filter (where c_acctbal < 0) as n_failed,
  coalesce(min('overdrawn ' || c_mktsegment) filter (where c_acctbal < 0), '') as first_problem from customer group by c_nationkey"""


def companion_files(spark, sf_dir):
    """Parts as files beside a source named like the first part of their directory."""
    p = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 6
    name = F.concat(F.element_at(F.split("p_name", " "), 1), F.when(kind == 0, " [CO].jpg").when(kind == 1, " [BG].png").when(kind == 2, ".mp4").when(kind == 3, ".mxl").when(kind == 4, ".jpg").otherwise(".txt"))
    files = L.split_paths(p.select(F.concat(F.lit("/lib/"), "p_brand", F.lit("_"), F.col("p_size").cast("string"), F.lit("/"), name).alias("path"), F.col("p_partkey").alias("size")), "path")
    sources = files.groupBy("dir").agg(F.min(F.regexp_replace("stem", r" \[(CO|BG)\]$", "")).alias("stem"))
    return L.companions(files, sources).select("dir", *[F.coalesce(c, F.lit("")).alias(c) for c in ("cover", "background", "video", "score")])


COMPANION_SQL = r"""
with f as (select '/lib/' || p_brand || '_' || p_size as dir, string_split(p_name, ' ')[1] as base, p_partkey % 6 as k from part),
p as (select *, dir || '/' || base || case k when 0 then ' [CO].jpg' when 1 then ' [BG].png' when 2 then '.mp4' when 3 then '.mxl' when 4 then '.jpg' else '.txt' end as path from f),
o as (select dir, min(base) as own from p group by dir),
g as (select dir, k, count(*) as n, min(path) filter (where lower(base) = lower(own)) as own_path, min(path) as any_path from p join o using (dir) where k < 5 group by dir, k),
c as (select dir, k, coalesce(own_path, case when n = 1 then any_path end) as pick from g)
select dir, coalesce(max(pick) filter (where k = 0), max(pick) filter (where k = 4), '') as cover, coalesce(max(pick) filter (where k = 1), '') as background,
  coalesce(max(pick) filter (where k = 2), '') as video, coalesce(max(pick) filter (where k = 3), '') as score from o left join c using (dir) group by dir"""


QUERIES = {
    "realign_records": realign_records, "retry_choices": retry_choices, "placement_records": placement_records, "alignment_records": alignment_records, "mean_scores": mean_scores,
    "window_words": window_words, "word_chunks": word_chunks, "earliest_releases": earliest_releases, "plain_titles": plain_titles, "candidate_scores": candidate_scores,
    "media_checks": media_checks, "path_keys": path_keys, "report_entries": report_entries, "tagged_lyrics": tagged_lyrics, "spread_syllables": spread_syllables,
    "batch_results": batch_results, "companion_files": companion_files,
}
ORACLES = {
    "realign_records": REALIGN_SQL, "retry_choices": RETRY_SQL, "placement_records": PLACEMENT_SQL, "alignment_records": ALIGNMENT_SQL, "mean_scores": MEAN_SQL,
    "window_words": WINDOW_SQL, "word_chunks": CHUNKS_SQL, "earliest_releases": RELEASES_SQL, "plain_titles": TITLES_SQL, "candidate_scores": CANDIDATE_SQL,
    "media_checks": MEDIA_SQL, "path_keys": PATHS_SQL, "report_entries": REPORT_SQL, "tagged_lyrics": TAGGED_SQL, "spread_syllables": SPREAD_SQL,
    "batch_results": BATCH_SQL, "companion_files": COMPANION_SQL,
}
