"""Chart and lyric texts as tables, and back.

A chart is a text of ``#TAG:value`` headers, note lines ``type beat length pitch text``, break
lines ``- beat [beat]`` and an ``E``. Lines are exploded with their position and parsed by expressions;
a chart with a malformed line is reported by ``chart_errors`` rather than half read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoline.functions import scalars as S
from chronoline.operators import ordered as O

#: The line grammar of charts.
NOTE = r"^([:*FRG])\s(-?\d+)\s(-?\d+)\s(-?\d+)\s(.*)$"
BREAK = r"^-\s(-?\d+)(?:\s(-?\d+))?\s*$"
TAG = r"^#([A-Za-z0-9_]+):(.*)$"
TAG_ORDER = ("TITLE", "ARTIST", "LANGUAGE", "MP3", "COVER", "BACKGROUND", "VIDEO", "VIDEOGAP", "GENRE", "YEAR", "EDITION", "CREATOR", "BPM", "GAP", "PREVIEWSTART")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """song_id (the file's path) and the whole text of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("song_id"), F.col("value").alias("text"))


def chart_lines(charts: DataFrame) -> DataFrame:
    """song_id, line_no, line up to the E or P2 line; empty lines and P1 are left out."""
    lines = charts.select("song_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("line_no", "line"))
    is_end = F.col("line").isin("E", "P2")
    ended = F.coalesce(F.max(is_end.cast("int")).over(O.upto(["song_id"], ["line_no"])), F.lit(0))
    return lines.withColumn("_ended", ended).where((F.col("_ended") == 0) & ~F.col("line").isin("", "P1")).drop("_ended")


def parse_headers(charts: DataFrame) -> DataFrame:
    """song_id, tags (upper-case names, the last duplicate wins), title, artist, bpm, gap_ms."""
    heads = chart_lines(charts).where(F.startswith("line", F.lit("#")))
    named = heads.select("song_id", "line_no", F.upper(F.regexp_extract("line", TAG, 1)).alias("name"), F.regexp_extract("line", TAG, 2).alias("value")).where("name <> ''")
    last = named.groupBy("song_id", "name").agg(F.max_by("value", "line_no").alias("value"))
    tags = last.groupBy("song_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("tags"))
    get = lambda k: F.element_at("tags", k)
    gap = F.coalesce(F.bround(S.parse_decimal(get("GAP"))), F.lit(0.0)).cast("long")
    return tags.select("song_id", "tags", F.coalesce(get("TITLE"), F.lit("")).alias("title"), F.coalesce(get("ARTIST"), F.lit("")).alias("artist"), S.parse_decimal(get("BPM")).alias("bpm"), gap.alias("gap_ms"))


def parse_entries(charts: DataFrame) -> DataFrame:
    """song_id, pos, kind, note_type, beat, len, pitch, text, is_word_start, end_beat, start, end of every note and break."""
    body = chart_lines(charts).where(~F.startswith("line", F.lit("#")))
    part = lambda p, k: F.regexp_extract("line", p, k)
    number = lambda p, k: part(p, k).try_cast("long")
    note = F.col("line").rlike(NOTE)
    rows = body.where(note | F.col("line").rlike(BREAK)).select(
        "song_id", (F.row_number().over(Window.partitionBy("song_id").orderBy("line_no")) - 1).cast("long").alias("pos"), F.when(note, "syl").otherwise("break").alias("kind"),
        F.when(note, part(NOTE, 1)).alias("note_type"), F.when(note, number(NOTE, 2)).otherwise(number(BREAK, 1)).alias("beat"),
        F.when(note, number(NOTE, 3)).alias("len"), F.when(note, number(NOTE, 4)).alias("pitch"), F.when(note, part(NOTE, 5)).alias("raw"),
        F.when(~note, number(BREAK, 2)).alias("end_beat"),
    )
    w = O.over(["song_id"], ["pos"])
    previous = F.last("raw", True).over(O.before(["song_id"], ["pos"]))
    after_break = F.coalesce(F.lag("kind").over(w), F.lit("break")) == "break"
    starts = after_break | F.startswith("raw", F.lit(" ")) | F.coalesce(F.endswith(previous, F.lit(" ")), F.lit(False))
    rows = rows.withColumn("is_word_start", F.when(F.col("kind") == "syl", starts)).withColumn("text", F.btrim("raw")).drop("raw")
    timed = rows.join(parse_headers(charts).select("song_id", "bpm", "gap_ms"), "song_id")
    at = lambda beat: S.beat_to_seconds(beat, F.col("gap_ms"), F.col("bpm"))
    end = F.when(F.col("kind") == "syl", at(F.col("beat") + F.col("len"))).otherwise(at(F.col("end_beat")))
    return timed.withColumns({"start": at(F.col("beat")), "end": end}).drop("bpm", "gap_ms")


def chart_errors(charts: DataFrame) -> DataFrame:
    """song_id, reason for each chart that must not be read: a malformed line, or no usable BPM."""
    lines = chart_lines(charts)
    bad_head = F.startswith("line", F.lit("#")) & ~F.col("line").rlike(TAG)
    bad_line = ~F.startswith("line", F.lit("#")) & ~F.col("line").rlike(NOTE) & ~F.col("line").rlike(BREAK)
    bad = lines.where(bad_head | bad_line).groupBy("song_id").agg(F.min_by("line", "line_no").alias("line"))
    bad = bad.select("song_id", F.concat(F.lit("malformed line: "), "line").alias("reason"))
    heads = charts.select("song_id").distinct().join(parse_headers(charts), "song_id", "left")
    no_bpm = heads.where(F.col("bpm").isNull()).join(bad, "song_id", "left_anti").select("song_id", F.lit("no usable BPM").alias("reason"))
    return bad.unionByName(no_bpm)


def render_charts(songs: DataFrame, entries: DataFrame, merge_melisma: bool = False) -> DataFrame:
    """song_id, text: headers in fixed order (empty ones left out), quantized entries, E.

    songs(song_id, bpm, gap_ms, tags map of the other headers); entries(song_id, pos, kind, start, end, pitch, text, is_word_start, note_type).
    """
    keyed = entries.join(songs.select("song_id", "bpm", "gap_ms"), "song_id")
    beat = lambda c: S.seconds_to_beat(F.col(c), F.col("gap_ms"), F.col("bpm"))
    keyed = keyed.withColumns({"beat": beat("start"), "len": S.seconds_to_beats(F.col("end") - F.col("start"), F.col("bpm")), "end_beat": F.when(F.col("kind") == "break", beat("end"))})
    q = O.quantize_entries(keyed, ["song_id"], ["pos"])
    q = q.withColumns({"is_word_start": F.coalesce("is_word_start", F.lit(False)), "n_len": F.coalesce("out_len", F.lit(0))})
    if merge_melisma:
        w = O.over(["song_id"], ["pos"])
        tail = (F.col("kind") == "syl") & (F.btrim("text") == "~")
        joins = tail & (F.lag("kind").over(w) == "syl") & (F.col("pitch") == F.lag("pitch").over(w)) & (F.col("start_beat") == F.lag(F.col("start_beat") + F.col("n_len")).over(w))
        q = O.islands(q, ["song_id"], ["pos"], ~F.coalesce(joins, F.lit(False)), "island")
        keep = [c for c in q.columns if c not in ("song_id", "island", "n_len")]
        q = q.groupBy("song_id", "island").agg(F.min_by(F.struct(*keep), "pos").alias("r"), F.sum("n_len").alias("n_len")).select("song_id", "r.*", "n_len")
        q = q.where(~((F.col("kind") == "syl") & (F.btrim("text") == "~") & (F.col("n_len") == 1)))
    seen = F.coalesce(F.max((F.col("kind") == "syl").cast("int")).over(O.before(["song_id"], ["pos"])), F.lit(0)) == 1
    space = F.when(F.col("is_word_start") & seen, " ").otherwise("")
    note = F.concat_ws(" ", "note_type", "start_beat", "n_len", "pitch", F.concat(space, "text"))
    line = F.when(F.col("kind") == "syl", note).otherwise(F.concat_ws(" ", F.lit("-"), "start_beat", "out_end"))
    body = q.select("song_id", "pos", line.alias("line")).groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    own = F.map_concat(
        F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("BPM", "GAP")),
        F.create_map(F.lit("BPM"), S.format_tempo(F.col("bpm").cast("double")), F.lit("GAP"), F.col("gap_ms").cast("string")),
    )
    heads = F.filter(F.transform(F.array(*map(F.lit, TAG_ORDER)), lambda t: F.concat(F.lit("#"), t, F.lit(":"), F.nullif(F.element_at(own, t), F.lit("")))), lambda x: x.isNotNull())
    out = songs.join(body, "song_id", "left").select("song_id", heads.alias("heads"), F.coalesce(F.transform("rows", lambda r: r["line"]), F.array().cast("array<string>")).alias("lines"))
    return out.select("song_id", F.concat(F.array_join(F.concat("heads", "lines", F.array(F.lit("E"))), "\n"), F.lit("\n")).alias("text"))


def rebase(charts: DataFrame) -> DataFrame:
    """song_id, text, beat_shift, old_gap_ms, new_gap_ms: the first note moves to beat 0 and GAP takes up the shift.

    A chart whose first note is at 0 stays as it is; charts without BPM or notes have a null text.
    """
    lines = charts.select("song_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    first = lines.where(F.col("line").rlike(NOTE)).groupBy("song_id").agg(F.min_by(F.regexp_extract("line", NOTE, 2).try_cast("long"), "line_no").alias("first"))
    info = parse_headers(charts).select("song_id", "bpm", "gap_ms", F.map_contains_key("tags", "GAP").alias("has_gap")).join(first, "song_id")
    info = info.withColumn("new_gap", F.bround(F.col("gap_ms") + F.col("first") * S.beat_ms(F.col("bpm"))).cast("long"))
    part = lambda p, k: F.regexp_extract("line", p, k)
    moved = lambda p, k: (part(p, k).try_cast("long") - F.col("first")).cast("string")
    gap_line = F.concat(F.lit("#GAP:"), F.col("new_gap").cast("string"))
    line = (
        F.when(F.col("line").rlike("(?i)^#GAP:"), gap_line)
        .when(F.col("line").rlike("(?i)^#BPM:") & ~F.col("has_gap"), F.concat("line", F.lit("\n"), gap_line))
        .when(F.col("line").rlike(NOTE), F.concat_ws(" ", part(NOTE, 1), moved(NOTE, 2), part(NOTE, 3), part(NOTE, 4), part(NOTE, 5)))
        .when(F.col("line").rlike(BREAK), F.concat_ws(" ", F.lit("-"), moved(BREAK, 1), F.when(part(BREAK, 2) != "", moved(BREAK, 2))))
        .otherwise(F.col("line"))
    )
    new = lines.join(info, "song_id").withColumn("line", line).groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
    out = charts.join(new, "song_id", "left").join(info, "song_id", "left")
    text = F.when(F.col("first") == 0, F.col("text")).otherwise(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return out.select("song_id", text.alias("text"), (-F.col("first")).alias("beat_shift"), F.col("gap_ms").alias("old_gap_ms"), F.when(F.col("first") == 0, F.col("gap_ms")).otherwise(F.col("new_gap")).alias("new_gap_ms"))


# lyrics


def parse_lyrics(lyrics: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, line: lyric lines without blanks, [annotations] and credits."""
    lines = lyrics.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("at", "raw"))
    kept = lines.withColumn("line", F.btrim("raw", F.lit(" \t\r\n"))).where("line <> ''").where(~F.col("line").rlike(r"^\[.*\]$") & ~F.col("line").rlike(r"(?i)^(paroles|lyrics powered by|www\.)"))
    return kept.select(key, (F.row_number().over(O.over([key], ["at"])) - 1).cast("long").alias("line_no"), "line")


def tokenize(lines: DataFrame, key: str) -> DataFrame:
    """key, pos, norm, original, line_no of every token; hyphens split, tokens that normalize to nothing go."""
    words = lines.select(key, "line_no", F.posexplode(F.split(F.btrim("line"), r"[\s-]+")).alias("at", "original"))
    words = words.withColumn("norm", S.normalize_word(F.col("original"))).where("norm <> ''")
    return words.select(key, (F.row_number().over(O.over([key], ["line_no", "at"])) - 1).cast("long").alias("pos"), "norm", "original", "line_no")


def parse_timed_lines(lyrics: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, t, line: one leading [mm:ss.f] a line, empty texts left out, in order of time then place."""
    lines = lyrics.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("at", "raw"))
    stamp = r"^\[(\d+):(\d+(?:\.\d+)?)\](.*)$"
    part = lambda k: F.regexp_extract("raw", stamp, k)
    rows = lines.where(F.col("raw").rlike(stamp)).select(key, "at", (part(1).try_cast("double") * 60 + part(2).try_cast("double")).alias("t"), F.btrim(part(3), F.lit(" \t\r")).alias("line"))
    return rows.where("line <> ''").select(key, (F.row_number().over(O.over([key], ["t", "at"])) - 1).cast("long").alias("line_no"), "t", "line")


def parse_tagged_lyrics(lyrics: DataFrame, key: str, text: str) -> DataFrame:
    """key, artist, title, album, length, synced, plain: several [mm:ss.f] stamps anywhere in a line each give a row; [ar:], [ti:], [al:] and [length:] are metadata.

    Keys without any stamp have no row.
    """
    lines = lyrics.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("at", "raw"))
    tag = lambda n: f"(?i)^\\[{n}:(.*?)\\]\\s*$"
    last = lambda n: F.max_by(F.btrim(F.regexp_extract("raw", tag(n), 1)), F.when(F.col("raw").rlike(tag(n)), F.col("at")))
    heads = lines.groupBy(key).agg(*[last(n).alias(c) for n, c in (("ar", "artist"), ("ti", "title"), ("al", "album"), ("length", "length"))])
    stamp = r"\[(\d+):(\d{2})(?:[.:](\d{1,3}))?\]"
    found = lines.withColumn("stamps", F.regexp_extract_all("raw", F.lit(f"({stamp})"), F.lit(1))).where(F.size("stamps") > 0)
    lyric = F.btrim(F.regexp_extract("raw", r"^.*\[\d+:\d{2}(?:[.:]\d{1,3})?\](.*)$", 1), F.lit(" \t\r"))
    rows = found.select(key, "at", lyric.alias("lyric"), F.posexplode("stamps").alias("_nth", "_stamp"))
    fraction = F.rpad(F.regexp_extract("_stamp", stamp, 3), 3, "0").try_cast("long")
    ms = F.regexp_extract("_stamp", stamp, 1).try_cast("long") * 60000 + F.regexp_extract("_stamp", stamp, 2).try_cast("long") * 1000 + F.coalesce(fraction, F.lit(0))
    timed = rows.withColumn("ms", ms)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    minutes = F.when(F.col("ms") >= 6_000_000, F.floor(F.col("ms") / 60000).cast("string")).otherwise(two(F.floor(F.col("ms") / 60000)))
    shown = F.concat(F.lit("["), minutes, F.lit(":"), two(F.floor(F.col("ms") % 60000 / 1000)), F.lit("."), two(F.floor(F.col("ms") % 1000 / 10)), F.lit("]"), "lyric")
    packed = timed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ms", "at", "_nth", "lyric", shown.alias("shown")))).alias("rows"))
    texts = packed.select(key, F.array_join(F.transform("rows", lambda r: r["shown"]), "\n").alias("synced"), F.array_join(F.transform("rows", lambda r: r["lyric"]), "\n").alias("plain"))
    return texts.join(heads, key, "left")


def write_charts(charts: DataFrame, path: str, name: str = "name") -> None:
    """Writes charts(name, text) as text, one folder a name (escaped as Spark escapes partition values), replacing what is there.

    A text keeps its line ends; Spark adds one line end behind it. Null texts are left out.
    """
    ends = F.regexp_replace("text", "\n$", "")
    charts.where(F.col("text").isNotNull()).select(F.col(name).alias("name"), ends.alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """charts(name, text) as write_charts wrote them."""
    return spark.read.text(path, wholetext=True).select(F.col("name").cast("string").alias("name"), F.col("value").alias("text"))
