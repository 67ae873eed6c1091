"""Queries of scores, lyric files and word likeness on the driver's tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from chronoline.functions import scalars as S
from chronoline.operators import alignment as A
from chronoline.operators import ordered as O
from chronoline.session import scratch_folder, table
from chronoline.sources import charts as C
from chronoline.sources import formats as V
from chronoline.sources import scores as X

STEPS = "CDEFGAB"


def repaired_scores(spark, sf_dir):
    """A score a user, as XML: of seven notes one has only dots, one runs two words together before a note without a text."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    ev = ev.withColumn("i", F.row_number().over(O.over(["user_id"], ["event_id"])) - 1)
    text = F.when(F.col("i") % 7 == 3, "..").when(F.col("i") % 7 == 5, F.concat("event_type", F.lit(",go"))).when(F.col("i") % 7 != 6, F.col("event_type"))
    lyric = F.coalesce(F.concat(F.lit("<lyric><syllabic>single</syllabic><text>"), text, F.lit("</text></lyric>")), F.lit(""))
    step = F.substring(F.lit(STEPS), (F.col("event_id") % 7 + 1).cast("int"), F.lit(1))
    note = F.concat(F.lit("<note><pitch><step>"), step, F.lit("</step><octave>"), (F.col("event_id") % 3 + 3).cast("string"), F.lit("</octave></pitch><duration>2</duration>"), lyric, F.lit("</note>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", note.alias("n")))), lambda x: x["n"]), "")
    head = '<score-partwise><part-list><score-part id="P1"><part-name>Voice</part-name></score-part></part-list><part id="P1"><measure><attributes><divisions>2</divisions></attributes>'
    files = ev.groupBy("user_id").agg(F.concat(F.lit(head), body, F.lit("</measure></part></score-partwise>")).alias("text")).select(F.col("user_id").cast("string").alias("song_id"), "text")
    words = X.sung_words(X.repair_lyrics(X.vocal_part(X.read_scores(files), "Voice")))
    first = F.get("syllables", F.lit(0))
    return words.select("song_id", F.col("pos").cast("long").alias("pos"), "text", "offset", F.size("syllables").cast("long").alias("notes"), first["midi"].cast("long").alias("midi"), F.round(F.aggregate("syllables", F.lit(0.0), lambda a, x: a + x["qlen"]), 6).alias("quarters"))


REPAIRED_SQL = f"""
with e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) - 1 as i, count(*) over (partition by user_id) as n from events),
t as (select *, case when i % 7 = 6 then case when i > 0 then 'go' end when i % 7 <> 3 then event_type || case when i % 7 = 2 and i + 1 < n then '..' when i % 7 = 5 then case when i + 1 < n then ',' else ',go' end else '' end end as text,
  12 * (event_id % 3 + 4) + [0, 2, 4, 5, 7, 9, 11][event_id % 7 + 1] as midi from e)
select user_id::varchar as song_id, row_number() over (partition by user_id order by i) - 1 as pos, text, i::double as "offset", (case when i % 7 = 2 and i + 1 < n then 2 else 1 end)::bigint as notes, midi::bigint as midi,
  (case when i % 7 = 2 and i + 1 < n then 2.0 else 1.0 end)::double as quarters
from t where text is not null"""


def lyric_files(spark, sf_dir):
    """Conversation turns as lyric files; those of even turns have no timed line."""
    c = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    text = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("[ti:x]\n[00:0"), (F.col("turn") % 10).cast("string"), F.lit(".50]"), F.regexp_replace("text", "\n", "\n[01:00.00]"))).otherwise(F.col("text"))
    V.register(spark)
    folder = f"{scratch_folder(spark)}/lyrics-{uuid4().hex}"
    c.select(name.alias("name"), text.alias("text")).repartition(4).write.format("song_lyric").mode("overwrite").option("path", folder).save()
    read = spark.read.format("song_lyric").option("path", folder).load().select("name", "text")
    lines = C.parse_timed_lines(read, "name", "text").groupBy("name").agg(F.count("*").alias("lines"), F.min("t").alias("first"), F.max("t").alias("last"))
    out = read.join(lines, "name", "left")
    return out.select("name", F.col("text").isNotNull().alias("timed"), F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("first", F.lit(-1.0)).alias("first"), F.coalesce("last", F.lit(-1.0)).alias("last"))


LYRIC_FILES_SQL = r"""
with c as (select 'c' || conv_id || '-' || turn as name, turn, string_split(text, chr(10)) as l from conversations),
n as (select *, len(list_filter(l, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) as k, trim(l[1], ' ' || chr(9) || chr(13)) <> '' as begins from c)
select name, turn % 2 = 1 and k > 0 as timed, (case when turn % 2 = 1 then k else 0 end)::bigint as lines,
  case when turn % 2 = 1 and k > 0 then case when begins then turn % 10 + 0.5 else 60.0 end else -1.0 end::double as first, case when turn % 2 = 1 and k > 0 then case when k > begins::int then 60.0 else turn % 10 + 0.5 end else -1.0 end::double as last
from n"""


def word_likeness(spark, sf_dir):
    """Each conversation turn's words against their own beginning, and file checks of customers."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.btrim("text"), r"\s+").alias("w"))
    c = c.withColumn("half", F.slice("w", 1, F.greatest(F.lit(1), (F.size("w") / 2).cast("int"))))
    ratio, tail = A.sequence_ratio(F.col("half"), F.col("w")), A.largest_insert(F.col("half"), F.col("w"))
    return c.select("conv_id", "turn", F.round(ratio, 9).alias("ratio"), tail.cast("long").alias("tail"))


LIKENESS_SQL = r"""
with c as (select conv_id, turn, len(regexp_split_to_array(trim(text), '\s+')) as n from conversations), h as (select *, greatest(1, n // 2) as m from c)
select conv_id, turn, round(2.0 * m / (n + m), 9) as ratio, (n - m)::bigint as tail from h"""


def file_checks(spark, sf_dir):
    """CRC of customers' names as file contents, and names that are flat fuzzy equal to their own beginning."""
    c = table(spark, sf_dir, "customer")
    alike = A.fuzzy_equal(F.col("c_name"), F.expr("left(c_name, 6 + c_custkey % 13)"))
    return c.select("c_custkey", S.crc_text(F.col("c_name")).alias("crc"), alike.alias("alike"))


CHECKS_SQL = """
with recursive b as (
  select c_custkey, c_name, 0 as k, 4294967295::bigint as c from customer
  union all
  select c_custkey, c_name, k + 1, list_reduce(list_prepend(xor(c, ascii(substr(c_name, k + 1, 1))::bigint), range(8)), lambda v, x: case when v % 2 = 1 then xor(v // 2, 3988292384::bigint) else v // 2 end)
  from b where k < length(c_name))
select c_custkey, lpad(lower(hex(xor(c, 4294967295::bigint))), 8, '0') as crc, 2.0 * least(length(c_name), 6 + c_custkey % 13) / (length(c_name) + least(length(c_name), 6 + c_custkey % 13)) >= 0.85 as alike
from b where k = length(c_name)"""

QUERIES = {"repaired_scores": repaired_scores, "lyric_files": lyric_files, "word_likeness": word_likeness, "file_checks": file_checks}
ORACLES = {"repaired_scores": REPAIRED_SQL, "lyric_files": LYRIC_FILES_SQL, "word_likeness": LIKENESS_SQL, "file_checks": CHECKS_SQL}
