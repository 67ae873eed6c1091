"""What a song folder gives, what its files are called in the output, and what a replacement renames: plans as rows, which whoever has the files carries out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.functions import scalars as S
from chronoline.sources import listings as L

KINDS = {1: "audio", 2: "video as audio", 3: "extracted audio"}


def song_inputs(files: DataFrame, work: str) -> DataFrame:
    """dir, kind, mp3, video, analysis, cover, background, score, extract, gap_applies, problem of each folder of files(dir, stem, ext, path).

    The one audio file is played and analysed; a video in its place serves as both, with its sound extracted for the analysis; of an avi the sound is extracted for both. extract is the file to
    make under the work folder, null where none is needed. A gap between sound and video is only looked for where they are different recordings.
    """
    primary = L.primary_source(files).join(files.select("path", "stem"), "path", "left").select("dir", "path", "stem", "tier", "problem")
    beside = L.companions(files, primary.where("path is not null").select("dir", "stem"))
    met = primary.join(beside, "dir", "left")
    kind = F.element_at(F.create_map(*(x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v)))), F.col("tier"))
    made = F.concat(F.lit(work.rstrip("/") + "/extracted/"), "stem", F.when(F.col("tier") == 3, ".mp3").otherwise(".wav"))
    have = F.col("problem").isNull()
    whole = F.when(have & (F.col("tier") > 1), made)
    return met.select(
        "dir", F.when(have, kind).alias("kind"), F.when(F.col("tier") == 3, whole).otherwise(F.when(have, F.col("path"))).alias("mp3"), F.when(F.col("tier") == 1, F.col("video")).otherwise(F.when(have, F.col("path"))).alias("video"),
        F.coalesce(whole, F.when(have, F.col("path"))).alias("analysis"), "cover", "background", "score", whole.alias("extract"), F.when(have, F.col("tier") == 1).alias("gap_applies"), "problem",
    )


def _suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def staged_names(songs: DataFrame, key: list[str]) -> DataFrame:
    """key, role, source, name, action of the files of songs(key, artist, title, mp3, video, cover, background).

    A file in two roles is copied once and named once; a picture that is cover and background needs no tag; a video beside its own sound is copied without sound.
    """
    base = S.safe_file_name(F.concat_ws(" - ", "artist", "title"))
    same = F.coalesce(F.col("cover") == F.col("background"), F.lit(False))
    plain = lambda c: F.concat(base, _suffix(F.col(c)))
    tagged = lambda c, tag: F.concat(base, F.when(same, "").otherwise(f" [{tag}]"), _suffix(F.col(c)))
    own_sound = F.coalesce(F.col("video") == F.col("mp3"), F.lit(False))
    role = lambda name, path, to, action: F.struct(F.lit(name).alias("role"), F.col(path).alias("source"), to.alias("name"), action.alias("action"))
    copied, again = F.lit("copy"), F.lit("same")
    rows = F.array(
        role("mp3", "mp3", plain("mp3"), copied), role("video", "video", plain("video"), F.when(own_sound, again).otherwise(F.lit("copy without sound"))),
        role("cover", "cover", tagged("cover", "CO"), copied), role("background", "background", tagged("background", "BG"), F.when(same, again).otherwise(copied)),
    )
    return songs.select(*key, F.explode(F.filter(rows, lambda r: r["source"].isNotNull())).alias("r")).select(*key, "r.*")


def replacements(files: DataFrame, tag: str, reverse: bool = False) -> DataFrame:
    """dir, stem, old_path, aside_path, new_path, action: charts that a tagged version replaces (the old one goes aside), or in reverse those whose old version comes back.

    Charts whose place aside, or in reverse whose tagged name, is taken are skipped. files has dir, stem, ext and path of a listing.
    """
    texts = files.where("ext = 'txt'").select("dir", "stem", "path")
    taken = files.select(F.col("path").alias("_taken")).distinct()
    mark = f" [{tag}]"
    place = lambda stem, end: F.concat("dir", F.lit("/"), stem, F.lit(end))
    if reverse:
        plans = texts.withColumns({"aside": place(F.col("stem"), f".{tag}.bak"), "tagged": place(F.col("stem"), f"{mark}.txt")}).join(taken.withColumnRenamed("_taken", "aside"), "aside", "left_semi")
        met = plans.join(taken, F.col("tagged") == F.col("_taken"), "left")
        return met.select("dir", "stem", F.col("aside").alias("old_path"), F.col("tagged").alias("aside_path"), F.col("path").alias("new_path"), F.when(F.col("_taken").isNull(), "restore").otherwise("skip").alias("action"))
    tagged = texts.where(F.endswith("stem", F.lit(mark))).select("dir", F.expr(f"left(stem, length(stem) - {len(mark)})").alias("stem"), F.col("path").alias("tagged"))
    met = tagged.join(texts.withColumnRenamed("path", "old"), ["dir", "stem"]).withColumn("aside", place(F.col("stem"), f".{tag}.bak"))
    met = met.join(taken, F.col("aside") == F.col("_taken"), "left")
    return met.select("dir", "stem", F.col("old").alias("old_path"), F.col("aside").alias("aside_path"), F.col("tagged").alias("new_path"), F.when(F.col("_taken").isNull(), "replace").otherwise("skip").alias("action"))


def carried_tags(old: DataFrame, new: DataFrame) -> DataFrame:
    """song_id, tags of a chart made anew from an old one: the old tags stay, but for those that new(song_id, tags) sets; names in upper case, empty values do not set."""
    upper = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: F.upper(k))
    told = new.select("song_id", F.map_filter(upper(F.col("tags")), lambda k, v: F.coalesce(v, F.lit("")) != "").alias("_new"))
    met = old.join(told, "song_id", "left").withColumn("_new", F.coalesce("_new", F.create_map().cast("map<string,string>")))
    kept = F.map_filter(upper(F.col("tags")), lambda k, v: ~F.map_contains_key("_new", k))
    both = F.map_concat(kept, "_new")
    return met.select("song_id", F.map_from_entries(F.array_sort(F.map_entries(both))).alias("tags"))
