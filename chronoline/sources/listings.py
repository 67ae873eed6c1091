"""File listings as tables: companions, sources, scans by extension, reports and content registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO = ("mp3", "ogg", "m4a", "wav", "flac", "opus")
VIDEO = ("mp4", "mkv", "avi", "webm", "mov", "mpg", "mpeg", "m4v")
DIRECT_VIDEO = ("mp4", "mkv", "webm")
IMAGES = ("jpg", "jpeg", "png")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """dir, stem, ext, path, size of all files under root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    return split_paths(files, "path")


def split_paths(files: DataFrame, path: str) -> DataFrame:
    """Adds dir, stem and lower-case ext of a path column."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return files.withColumns({"dir": F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "stem": F.regexp_replace(name, r"\.[^.]*$", ""), "ext": F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))})


def with_partner(files: DataFrame, exts: tuple[str, ...], partner_exts: tuple[str, ...], root: str | None = None) -> DataFrame:
    """Files of some extensions whose directory holds one of the same stem with a partner extension; files directly in root are not looked at."""
    wanted = files.where(F.col("ext").isin(*exts))
    if root is not None:
        wanted = wanted.where(F.col("dir") != root.rstrip("/"))
    partners = files.where(F.col("ext").isin(*partner_exts)).select("dir", F.lower("stem").alias("_stem"))
    return wanted.withColumn("_stem", F.lower("stem")).join(partners, ["dir", "_stem"], "left_semi").drop("_stem")


def audio_files(files: DataFrame, exts: tuple[str, ...] = ("mp3", "ogg", "m4a", "mp4"), proper: tuple[str, ...] = ("mp3", "ogg", "m4a")) -> DataFrame:
    """Audio files; an mp4 counts only where its directory has no proper audio."""
    found = files.where(F.col("ext").isin(*exts))
    covered = files.where(F.col("ext").isin(*proper)).select("dir").distinct()
    return found.where("ext <> 'mp4'").unionByName(found.where("ext = 'mp4'").join(covered, "dir", "left_anti"))


def primary_source(files: DataFrame) -> DataFrame:
    """dir, path, tier, problem: the one audio file, else the one direct-audio video, else the one avi; several at the tier reached, or none, are a problem."""
    tier = F.when(F.col("ext").isin(*AUDIO), 1).when(F.col("ext").isin(*DIRECT_VIDEO), 2).when(F.col("ext") == "avi", 3)
    ranked = files.withColumn("tier", tier)
    best = ranked.groupBy("dir").agg(F.min("tier").alias("tier"))
    at = ranked.join(best, ["dir", "tier"]).groupBy("dir", "tier").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    found = best.join(at, ["dir", "tier"], "left")
    problem = F.when(F.col("n").isNull(), "no audio source").when(F.col("n") > 1, "several sources")
    return found.select("dir", F.when(F.col("n") == 1, F.col("path")).alias("path"), "tier", problem.alias("problem"))


def companions(files: DataFrame, sources: DataFrame) -> DataFrame:
    """dir, cover, background, video, score of each source(dir, stem): same stem with [CO] or [BG], a video or sheet music of the same stem, else the only one of its kind."""
    cut = F.lower(F.btrim(F.regexp_replace("stem", r"(?i)\s*\[(co|bg)\]\s*$", "")))
    tag = F.lower(F.regexp_extract("stem", r"(?i)\[(co|bg)\]\s*$", 1))
    kind = (
        F.when(F.col("ext").isin(*IMAGES), F.when(tag == "co", "cover").when(tag == "bg", "background").otherwise("image"))
        .when(F.col("ext").isin(*VIDEO), "video").when(F.col("ext").isin("mxl", "musicxml", "xml"), "score")
    )
    tagged = files.withColumns({"kind": kind, "_base": cut}).where("kind is not null")
    own = sources.select("dir", F.lower("stem").alias("_own"))
    near = tagged.join(own, "dir").withColumn("same", (F.col("_base") == F.col("_own")).cast("int"))
    grouped = near.groupBy("dir", "kind").agg(F.count("*").alias("n"), F.sum("same").alias("n_same"), F.min(F.when(F.col("same") == 1, F.col("path"))).alias("own_path"), F.min("path").alias("any_path"))
    chosen = F.when(F.col("n_same") >= 1, F.col("own_path")).when(F.col("n") == 1, F.col("any_path"))
    pick = lambda k: F.max(F.when(F.col("kind") == k, chosen))
    out = grouped.groupBy("dir").agg(F.coalesce(pick("cover"), pick("image")).alias("cover"), pick("background").alias("background"), pick("video").alias("video"), pick("score").alias("score"))
    return sources.select("dir").distinct().join(out, "dir", "left")


def existing_chart(files: DataFrame, markers: tuple[str, ...] = (" [REALIGN]", " [PITCH]", " [FIXED]")) -> DataFrame:
    """dir, path, problem: the one text file of a directory that is no output; of several the one named like the directory."""
    marked = None
    for m in markers:
        here = F.contains(F.col("stem"), F.lit(m))
        marked = here if marked is None else marked | here
    texts = files.where((F.col("ext") == "txt") & ~marked)
    folder = F.regexp_extract("dir", r"([^/]*)$", 1)
    g = texts.groupBy("dir").agg(F.count("*").alias("n"), F.min("path").alias("one"), F.min(F.when(F.col("stem") == folder, F.col("path"))).alias("named"))
    path = F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("named"))
    return g.select("dir", path.alias("path"), F.when(path.isNull(), "several charts").alias("problem"))


def report_paths(lines: DataFrame, line: str = "value") -> DataFrame:
    """Paths of a report: no blank, indented, ERROR: or 'No videos' lines."""
    kept = F.rtrim(F.regexp_replace(line, r"\s+$", ""))
    return lines.select(kept.alias("path")).where((F.col("path") != "") & ~F.col("path").rlike(r"^([ \t]|ERROR:|No videos)"))


# media decisions


def bit_rate_estimate(width: Column, height: Column, fps: Column, crf: Column) -> Column:
    from chronoline.functions.scalars import bit_rate_for_crf

    return bit_rate_for_crf(width, height, fps, crf)


def oversized(media: DataFrame, max_crf: float, width: int = 1280, height: int = 720, fps: float = 30.0) -> DataFrame:
    """Videos worth converting: not hevc, over a limit, and of a known CRF up to max_crf, or of a bit rate that is unknown or above its estimate."""
    big = (F.col("width") > width) | (F.col("height") > height) | (F.col("fps") > fps)
    estimate = bit_rate_estimate(F.col("width"), F.col("height"), F.col("fps"), F.lit(max_crf))
    known = F.col("src_crf").isNotNull()
    rich = (known & (F.col("src_crf") <= max_crf)) | (~known & (F.col("bit_rate").isNull() | (F.col("bit_rate") > estimate)))
    return media.where((F.coalesce("codec", F.lit("")) != "hevc") & big & rich)


def conversion_problem(size: Column, width: Column, height: Column, duration: Column, original: Column, has_audio: Column, had_audio: Column) -> Column:
    """Why a converted file is refused, null if it is not."""
    drift = F.abs(duration - original) > F.greatest(F.lit(1.0), original * 0.02)
    return (
        F.when(F.coalesce(size, F.lit(0)) <= 0, "empty file").when((F.coalesce(width, F.lit(0)) <= 0) | (F.coalesce(height, F.lit(0)) <= 0), "no picture")
        .when(F.coalesce(drift, F.lit(True)), "duration differs").when(F.coalesce(had_audio, F.lit(False)) & ~F.coalesce(has_audio, F.lit(False)), "audio lost")
    )


def loudness_plausible(lufs: Column, true_peak: Column) -> Column:
    return F.coalesce(lufs.between(-70, 0) & true_peak.between(-99, 9), F.lit(False))


# content registries


def merge_registries(legacy: DataFrame, current: DataFrame) -> DataFrame:
    """path_key, crc: both registries, the current one winning."""
    both = legacy.withColumnRenamed("crc", "_old").join(current.withColumnRenamed("crc", "_new"), "path_key", "full_outer")
    return both.select("path_key", F.coalesce("_new", "_old").alias("crc"))


def registry_actions(files: DataFrame, registry: DataFrame, backups: DataFrame) -> DataFrame:
    """path_key, crc, action, moved_from for files(path_key, crc).

    skip: the same content is on record here; move: it is on record elsewhere (the last path by name); record: no entry but
    a backup; redo: another content is on record; new: none of these.
    """
    here = registry.select("path_key", F.col("crc").alias("_known"))
    there = registry.groupBy("crc").agg(F.max("path_key").alias("_other"))
    joined = files.join(here, "path_key", "left").join(there, "crc", "left").join(backups.select("path_key").distinct().withColumn("_saved", F.lit(True)), "path_key", "left")
    action = (
        F.when(F.col("_known") == F.col("crc"), "skip").when(F.col("_other").isNotNull() & (F.col("_other") != F.col("path_key")), "move")
        .when(F.col("_known").isNotNull(), "redo").when(F.col("_saved"), "record").otherwise("new")
    )
    return joined.select("path_key", "crc", action.alias("action"), F.when(action == "move", F.col("_other")).alias("moved_from"))


def upsert(registry: DataFrame, actions: DataFrame) -> DataFrame:
    """The registry after the actions: moved entries leave their old path, acted files have their content."""
    gone = actions.where("action = 'move'").select(F.col("moved_from").alias("path_key"))
    kept = registry.join(gone, "path_key", "left_anti")
    return merge_registries(kept, actions.select("path_key", "crc"))


def keep_closest(candidates: DataFrame, key: list[str], text: str, distance: str, order: list[str]) -> DataFrame:
    """One candidate a trimmed text, the closest (the first in order on ties), with dupe_count; blank texts never fold."""
    trimmed = F.nullif(F.btrim(F.coalesce(text, F.lit(""))), F.lit(""))
    group = F.coalesce(F.concat(F.lit("t"), trimmed), F.concat_ws("|", F.lit("i"), *order))
    rest = [c for c in candidates.columns if c not in key]
    far = F.struct(F.coalesce(distance, F.lit(float("inf"))), *order)
    g = candidates.withColumn("_group", group).groupBy(*key, "_group").agg(F.min_by(F.struct(*rest), far).alias("_best"), (F.count("*") - 1).alias("dupe_count"))
    return g.select(*key, "_best.*", "dupe_count")


def best_candidate(candidates: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first candidate of each key in the given ordering."""
    from pyspark.sql import Window

    return candidates.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def first_release(releases: DataFrame, key: str) -> DataFrame:
    """key, release_id: the release with the earliest date (as text, the first by pos on ties), else the first one; releases(key, pos, release_id, date).

    Releases without an id do not count, an empty date is none; keys without any have no row.
    """
    known = releases.where("release_id is not null and release_id <> ''").withColumn("date", F.nullif("date", F.lit("")))
    dated = F.min_by(F.when(F.col("date").isNotNull(), F.col("release_id")), F.when(F.col("date").isNotNull(), F.struct("date", "pos")))
    return known.groupBy(key).agg(F.coalesce(dated, F.min_by("release_id", "pos")).alias("release_id"))
