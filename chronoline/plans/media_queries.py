"""Queries of probe answers, embedded pictures and media boxes on the driver's tables, which Spark turns into such answers and files first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoline.session import table
from chronoline.sources import media_bytes as M
from chronoline.sources import probes as B


def probe_facts(spark, sf_dir):
    """Line items as videos; some answers are no JSON, some have no stream, some no usable bit rate."""
    li = table(spark, sf_dir, "lineitem")
    rate = F.when(F.col("l_linenumber") == 1, "30000/1001").when(F.col("l_linenumber") == 2, "1/0").when(F.col("l_linenumber") < 6, F.concat((F.col("l_quantity") + 1).cast("int").cast("string"), F.lit("/1")))
    bits = F.when(F.col("l_suppkey") % 7 == 0, "N/A").when(F.col("l_suppkey") % 7 > 1, F.floor("l_extendedprice").cast("string"))
    stream = F.struct(F.col("l_shipmode_").alias("codec_name"), F.col("l_quantity").cast("int").alias("width"), (F.col("l_partkey") % 1000).alias("height"), rate.alias("r_frame_rate"), bits.alias("bit_rate"))
    li = li.withColumn("l_shipmode_", F.when(F.col("l_returnflag") == "A", "hevc").otherwise("h264"))
    answer = F.when(F.col("l_orderkey") % 11 == 0, '{"streams": [').when(F.col("l_orderkey") % 11 == 1, '{"streams": []}').otherwise(F.to_json(F.struct(F.array(stream).alias("streams"))))
    sound = F.when(F.col("l_orderkey") % 5 == 0, "broken").otherwise(F.to_json(F.struct(F.struct((F.col("l_extendedprice") / 100).cast("string").alias("duration"), F.lit("128000").alias("bit_rate")).alias("format"),
        F.array(F.struct(F.when(F.col("l_tax") > 0.04, "audio").otherwise("video").alias("codec_type"))).alias("streams"))))
    seen = B.video_facts(li.select("l_orderkey", answer.alias("answer"), sound.alias("sound"))).withColumnRenamed("malformed", "video_malformed")
    both = B.container_facts(seen, "sound")
    sums = both.groupBy("l_orderkey").agg(
        F.count("*").alias("rows"), F.count_if("video_malformed").alias("malformed"), F.sum("width").alias("width"), F.sum("height").alias("height"), F.round(F.sum("fps"), 6).alias("fps"),
        F.count_if(F.col("codec") == "hevc").alias("hevc"), F.sum("bit_rate").alias("bits"), F.count_if("malformed").alias("sound_malformed"), F.round(F.sum("seconds"), 4).alias("seconds"),
        F.sum("container_bit_rate").alias("container_bits"), F.count_if("has_audio").alias("audio"),
    )
    return sums.fillna(0)


PROBE_SQL = """
with l as (select *, l_orderkey % 11 = 0 as bad, l_orderkey % 11 > 1 and l_suppkey % 7 > 0 as said, l_orderkey % 5 = 0 as mute from lineitem),
f as (select *, case when l_linenumber = 1 then 30000.0 / 1001.0 when l_linenumber = 2 or l_linenumber >= 6 then 0.0 else (l_quantity + 1)::int end::double as fps from l)
select l_orderkey, count(*) as rows, count(*) filter (where bad) as malformed, coalesce(sum(l_quantity::int) filter (where said), 0)::bigint as width, coalesce(sum(l_partkey % 1000) filter (where said), 0)::bigint as height,
  coalesce(round(sum(fps) filter (where said), 6), 0) as fps, count(*) filter (where said and l_returnflag = 'A') as hevc, coalesce(sum(floor(l_extendedprice)) filter (where said and l_suppkey % 7 > 1), 0)::bigint as bits,
  count(*) filter (where mute) as sound_malformed, coalesce(round(sum(l_extendedprice / 100) filter (where not mute), 4), 0) as seconds, (128000 * count(*) filter (where not mute))::bigint as container_bits,
  count(*) filter (where not mute and l_tax > 0.04) as audio
from f group by l_orderkey"""


def found_candidates(spark, sf_dir):
    """What a search answers for each user: their events as candidates, for every seventh a broken text."""
    ev = table(spark, sf_dir, "events")
    one = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("trackName"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("artistName"),
        F.round(F.col("value") * 2, 3).alias("duration"), F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 8 == 0).alias("instrumental"), F.when(F.col("value") > 5, F.concat(F.lit("[00:01.0]"), F.col("props"))).alias("syncedLyrics"))
    whole = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("event_id", one.alias("c")))), lambda x: x["c"]))
    answers = ev.groupBy("user_id").agg(whole.alias("whole")).select("user_id", F.when(F.col("user_id") % 7 == 0, F.expr("left(whole, length(whole) - 1)")).otherwise(F.col("whole")).alias("answer"))
    rows = B.search_candidates(answers, ["user_id"])
    broken = B.malformed_answers(answers, ["user_id"])
    found = rows.select("user_id", F.col("pos").cast("long").alias("pos"), "id", "track_name", "artist_name", "duration", "instrumental", F.coalesce("synced_lyrics", F.lit("")).alias("synced"))
    both = found.unionByName(broken.select("user_id"), allowMissingColumns=True)
    return both.fillna(-1, ["pos", "id", "duration"]).fillna("", ["track_name", "artist_name", "synced"]).fillna(False, ["instrumental"])


CANDIDATES_SQL = """
with c as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as pos, event_id as id, event_type as track_name,
    case when event_id % 3 > 0 then 'user' || user_id else '' end as artist_name, round(value * 2, 3) as duration, event_id % 8 = 0 as instrumental,
    case when value > 5 then '[00:01.0]' || props else '' end as synced from events)
select user_id, pos::bigint as pos, id, track_name, artist_name, duration, instrumental, synced from c where user_id % 7 <> 0
union all select distinct user_id, -1, -1, '', '', -1.0, false, '' from events where user_id % 7 = 0"""


def _big_endian(n: Column, size: int) -> Column:
    """n as so many bytes."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))


def _bytes(text: str) -> Column:
    return F.lit(text.encode("latin-1"))


def cover_pictures(spark, sf_dir):
    """Documents' texts as pictures in tagged files of four kinds; the tags of every fifth are a byte shorter than they say."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("image"))
    size = F.octet_length("image")
    text = lambda b: F.concat(_big_endian(F.octet_length(b), 4), b)
    block = F.concat(_big_endian(F.lit(3), 4), text(_bytes("image/png")), text(_bytes("front")), _big_endian(F.lit(0), 16), _big_endian(size, 4), F.col("image"))
    frame = F.concat(_bytes("\0image/png\0\3front\0"), F.col("image"))
    tag = F.concat(_bytes("APIC"), _big_endian(F.octet_length(frame), 4), _bytes("\0\0"), frame)
    n = F.octet_length(tag)
    safe = F.concat(*[_big_endian(F.shiftright(n, 7 * k).bitwiseAND(127), 1) for k in (3, 2, 1, 0)])
    id3 = F.concat(_bytes("ID3\3\0\0"), safe, tag)
    flac = F.concat(_bytes("fLaC\0\0\0\2ab\x86"), _big_endian(F.octet_length(block), 3), block)
    box = lambda kind, body: F.concat(_big_endian(F.octet_length(body) + 8, 4), _bytes(kind), body)
    inner = box("ilst", box("covr", box("data", F.concat(_big_endian(F.lit(14), 8), F.col("image")))))
    mp4 = F.concat(box("ftyp", _bytes("M4A ")), box("moov", box("udta", box("meta", F.concat(_big_endian(F.lit(0), 4), inner)))))
    whole = F.when(F.col("doc_id") % 4 == 0, id3).when(F.col("doc_id") % 4 == 1, flac).when(F.col("doc_id") % 4 == 2, mp4).otherwise(F.concat(_bytes("no tag"), F.col("image")))
    files = docs.select(F.col("doc_id").alias("path_key"), whole.alias("whole")).select("path_key", F.when(F.col("path_key") % 5 == 0, F.expr("substring(whole, 1, octet_length(whole) - 1)")).otherwise(F.col("whole")).alias("content"))
    return M.embedded_pictures(files).select(F.col("path_key").alias("doc_id"), F.coalesce("container", F.lit("")).alias("container"), F.coalesce(F.sha2("picture", 256), F.lit("")).alias("picture_sha256"))


COVERS_SQL = """
select doc_id, case when doc_id % 5 = 0 or coalesce(text, '') = '' then '' else ['id3', 'flac', 'mp4', ''][doc_id % 4 + 1] end as container,
  case when doc_id % 5 <> 0 and doc_id % 4 <> 3 and coalesce(text, '') <> '' then sha256(text) else '' end as picture_sha256
from documents"""


def fragment_spans(spark, sf_dir):
    """Orders as fragmented videos, a fragment a line item; every ninth breaks off in a header. Located at two thirds."""
    li = table(spark, sf_dir, "lineitem")
    zeros = lambda n: F.repeat(F.lit("00"), n.cast("int"))
    box = lambda kind, size: F.concat(F.lpad(F.hex(size.cast("long")), 8, "0"), F.lit(kind.encode().hex()), zeros(size - 8))
    body = F.concat(box("moof", 16 + F.col("l_quantity")), box("mdat", 8 + F.col("l_quantity") * 7))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", body.alias("b")))), lambda x: x["b"]), "")
    songs = li.groupBy("l_orderkey").agg(listed.alias("body"))
    head = F.concat(box("ftyp", F.lit(24)), box("moov", 100 + F.col("l_orderkey") % 50))
    hexed = F.concat(head, F.col("body"), F.when(F.col("l_orderkey") % 9 == 0, F.lit("00000000ff")).otherwise(F.lit("")))
    files = songs.select(F.col("l_orderkey").alias("path_key"), F.unhex(hexed).alias("content"))
    found = M.fragments_near(M.media_boxes(files), F.lit(2.0) / 3)
    return found.select(F.col("path_key").alias("l_orderkey"), "init_bytes", "fragment_offset", "fragment_bytes")


FRAGMENTS_SQL = """
with b as (select l_orderkey, (24 + l_quantity * 8)::bigint as span, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as k, (124 + l_orderkey % 50)::bigint as init from lineitem),
o as (select *, init + sum(span) over (partition by l_orderkey order by k) - span as place, lead(span) over (partition by l_orderkey order by k) as after,
        init + sum(span) over (partition by l_orderkey) + case when l_orderkey % 9 = 0 then 5 else 0 end as total from b),
t as (select *, floor(total * (2.0::double / 3))::bigint as target from o),
c as (select *, row_number() over (partition by l_orderkey order by k desc) as r, (select count(*) from t u where u.l_orderkey = t.l_orderkey and u.place > u.target) as behind from t where place <= target)
select l_orderkey, init as init_bytes, place::bigint as fragment_offset, (span + coalesce(after, 0))::bigint as fragment_bytes from c where r = 1 and (l_orderkey % 9 <> 0 or behind > 0)"""

QUERIES = {"probe_facts": probe_facts, "found_candidates": found_candidates, "cover_pictures": cover_pictures, "fragment_spans": fragment_spans}
ORACLES = {"probe_facts": PROBE_SQL, "found_candidates": CANDIDATES_SQL, "cover_pictures": COVERS_SQL, "fragment_spans": FRAGMENTS_SQL}
