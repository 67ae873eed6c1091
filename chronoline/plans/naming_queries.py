"""Queries of song folders, output names and replacements on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoline.session import table
from chronoline.sources import listings as L
from chronoline.sources import naming as N

#: Fixed values of the queries: what the parts of a folder are as files.
ENDS = [".mp3", " [CO].jpg", ".mp4", ".avi", " [BG].png", ".mxl", ".txt", ".ogg"]


def song_folders(spark, sf_dir):
    """Parts as files, a few to a folder."""
    p = table(spark, sf_dir, "part")
    ends = F.array(*map(F.lit, ENDS))
    name = F.concat(F.element_at(F.split("p_name", " "), 1), F.get(ends, (F.col("p_partkey") * 7 % 8).cast("int")))
    files = L.split_paths(p.select(F.concat(F.lit("/lib/"), (F.col("p_partkey") / 3).cast("long").cast("string"), F.lit("/"), name).alias("path")).distinct(), "path")
    out = N.song_inputs(files, "/work")
    return out.select("dir", *[F.coalesce(c, F.lit("")).alias(c) for c in ("kind", "mp3", "video", "analysis", "cover", "background", "score", "extract", "problem")], F.coalesce("gap_applies", F.lit(False)).alias("gap_applies"))


FOLDERS_SQL = f"""
with f as (select distinct '/lib/' || (p_partkey // 3) as dir, string_split(p_name, ' ')[1] as base, {ENDS}[p_partkey * 7 % 8 + 1] as e from part),
t as (select *, dir || '/' || base || e as path, case when e in ('.mp3', '.ogg') then 1 when e = '.mp4' then 2 when e = '.avi' then 3 end as tier,
  case e when ' [CO].jpg' then 'cover' when ' [BG].png' then 'background' when '.mp4' then 'video' when '.avi' then 'video' when '.mxl' then 'score' end as kind from f),
m as (select dir, min(tier) as tier from t group by dir),
s as (select m.dir, m.tier, count(path) as n, min(path) as path, min(base) as own from m left join t on t.dir = m.dir and t.tier = m.tier group by all),
g as (select t.dir, t.kind, count(*) as n, min(path) filter (where lower(base) = lower(own)) as own_path, min(t.path) as any_path from t join (select dir, own from s where n = 1) o using (dir) where t.kind is not null group by all),
c as (select dir, kind, coalesce(own_path, case when n = 1 then any_path end) as pick from g),
b as (select dir, max(pick) filter (where kind = 'cover') as cover, max(pick) filter (where kind = 'background') as background, max(pick) filter (where kind = 'video') as video, max(pick) filter (where kind = 'score') as score from c group by dir),
x as (select s.*, cover, background, video, score, n = 1 as good, '/work/extracted/' || own || case when s.tier = 3 then '.mp3' else '.wav' end as made from s left join b using (dir))
select dir, case when good then ['audio', 'video as audio', 'extracted audio'][tier] else '' end as kind, case when not good then '' when tier = 3 then made else path end as mp3,
  coalesce(case when tier = 1 then video when good then path end, '') as video, case when not good then '' when tier = 1 then path else made end as analysis, coalesce(cover, '') as cover, coalesce(background, '') as background,
  coalesce(score, '') as score, case when good and tier > 1 then made else '' end as extract, case when tier is null then 'no audio source' when n > 1 then 'several sources' else '' end as problem, coalesce(good and tier = 1, false) as gap_applies
from x"""


def output_names(spark, sf_dir):
    """Customers as songs."""
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat("c_mktsegment", F.lit("?")).alias("artist"), F.col("c_name").alias("title"), F.lit("/in/a.mp4").alias("mp3"),
        F.when(F.col("c_custkey") % 3 == 0, "/in/a.mp4").when(F.col("c_custkey") % 3 == 1, "/in/v.webm").alias("video"), F.when(F.col("c_custkey") % 4 > 0, "/in/p.jpg").alias("cover"),
        F.when(F.col("c_custkey") % 4 == 1, "/in/p.jpg").when(F.col("c_custkey") % 4 > 1, "/in/b.png").alias("background"),
    )
    return N.staged_names(c, ["c_custkey"])


NAMES_SQL = """
with b as (select c_custkey, c_mktsegment || ' - ' || c_name as base from customer)
select c_custkey, 'mp3' as role, '/in/a.mp4' as source, base || '.mp4' as name, 'copy' as action from b
union all select c_custkey, 'video', case when c_custkey % 3 = 0 then '/in/a.mp4' else '/in/v.webm' end, base || case when c_custkey % 3 = 0 then '.mp4' else '.webm' end, case when c_custkey % 3 = 0 then 'same' else 'copy without sound' end from b where c_custkey % 3 < 2
union all select c_custkey, 'cover', '/in/p.jpg', base || case when c_custkey % 4 = 1 then '' else ' [CO]' end || '.jpg', 'copy' from b where c_custkey % 4 > 0
union all select c_custkey, 'background', case when c_custkey % 4 = 1 then '/in/p.jpg' else '/in/b.png' end, base || case when c_custkey % 4 = 1 then '.jpg' else ' [BG].png' end, case when c_custkey % 4 = 1 then 'same' else 'copy' end from b where c_custkey % 4 > 0"""


def chart_replacements(spark, sf_dir):
    """Orders as charts; of some there is a tagged version, of some an old one aside."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    at = lambda end: F.concat(F.lit("/s/"), (F.col("o_orderkey") % 100).cast("string"), F.lit("/c"), F.col("o_orderkey").cast("string"), F.lit(end))
    paths = F.filter(F.array(at(".txt"), F.when(F.col("o_orderkey") % 3 == 0, at(" [REALIGNED].txt")), F.when(F.col("o_orderkey") % 4 == 0, at(".REALIGNED.bak"))), lambda p: p.isNotNull())
    files = L.split_paths(o.select(F.explode(paths).alias("path")), "path")
    return N.replacements(files, "REALIGNED").withColumn("way", F.lit("there")).unionByName(N.replacements(files, "REALIGNED", reverse=True).withColumn("way", F.lit("back")))


REPLACED_SQL = """
with o as (select '/s/' || (o_orderkey % 100) as dir, 'c' || o_orderkey as stem, o_orderkey % 3 = 0 as tagged, o_orderkey % 4 = 0 as aside from orders),
p as (select *, dir || '/' || stem as base from o)
select dir, stem, base || '.txt' as old_path, base || '.REALIGNED.bak' as aside_path, base || ' [REALIGNED].txt' as new_path, case when aside then 'skip' else 'replace' end as action, 'there' as way from p where tagged
union all select dir, stem, base || '.REALIGNED.bak', base || ' [REALIGNED].txt', base || '.txt', case when tagged then 'skip' else 'restore' end, 'back' from p where aside"""


def kept_tags(spark, sf_dir):
    """Suppliers and customers as old and new tags of a song."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("song_id"), F.create_map(F.lit("Title"), F.col("s_name"), F.lit("GENRE"), F.lit("x"), F.lit("year"), F.lit("1999")).alias("tags"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("song_id"), F.create_map(F.lit("TITLE"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).otherwise(""), F.lit("year"), F.lit("2001"), F.lit("GAP"), F.lit("7")).alias("tags"))
    out = N.carried_tags(s, c)
    return out.select("song_id", F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("tags"))


TAGS_SQL = """
select s_suppkey::varchar as song_id, concat_ws(';', case when c_custkey is not null then 'GAP=7' end, 'GENRE=x', 'TITLE=' || case when c_custkey % 4 = 0 then c_name else s_name end, 'YEAR=' || case when c_custkey is not null then '2001' else '1999' end) as tags
from supplier left join customer on c_custkey = s_suppkey and c_custkey % 2 = 0"""

QUERIES = {"song_folders": song_folders, "output_names": output_names, "chart_replacements": chart_replacements, "kept_tags": kept_tags}
ORACLES = {"song_folders": FOLDERS_SQL, "output_names": NAMES_SQL, "chart_replacements": REPLACED_SQL, "kept_tags": TAGS_SQL}
