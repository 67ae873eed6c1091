"""Answers of probes and searches as they come: JSON texts, read as variants.

An answer that is no JSON is kept apart from one that says nothing: ``malformed`` is true and all facts are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parsed(answers: DataFrame, answer: str) -> DataFrame:
    v = F.try_parse_json(F.col(answer))
    return answers.withColumns({"_v": v, "malformed": F.coalesce(F.nullif(F.col(answer), F.lit("")).isNull() | v.isNull(), F.lit(True))})


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("_v", path, kind)


def rate(text: Column) -> Column:
    """Frames a second of "30000/1001" or "25"; 0 where it is no number or divides by nought."""
    top, bottom = F.try_element_at(F.split(text, "/"), F.lit(1)).try_cast("double"), F.try_element_at(F.split(text, "/"), F.lit(2))
    return F.coalesce(F.when(bottom.isNull(), top).otherwise(F.try_divide(top, bottom.try_cast("double"))), F.lit(0.0))


def video_facts(probes: DataFrame, answer: str = "answer") -> DataFrame:
    """Adds malformed, width, height, fps, codec, bit_rate of the first stream; all null without one, or where its bit rate is no whole number."""
    parsed = _parsed(probes, answer)
    said = _get("$.streams[0].bit_rate", "string")
    read = _get("$.streams[0]", "variant").isNotNull() & (said.isNull() | said.try_cast("long").isNotNull())
    fact = lambda c: F.when(read, c)
    return parsed.withColumns(
        {
            "width": fact(_get("$.streams[0].width", "long")), "height": fact(_get("$.streams[0].height", "long")),
            "fps": fact(rate(F.coalesce(_get("$.streams[0].r_frame_rate", "string"), F.lit("0/1")))),
            "codec": fact(_get("$.streams[0].codec_name", "string")), "bit_rate": fact(said.try_cast("long")),
        }
    ).drop("_v")


def container_facts(probes: DataFrame, answer: str = "answer") -> DataFrame:
    """Adds malformed, seconds, container_bit_rate and has_audio: whether any stream is one of sound, false without streams."""
    parsed = _parsed(probes, answer)
    kinds = F.transform(F.coalesce(_get("$.streams", "array<variant>"), F.array().cast("array<variant>")), lambda s: F.try_variant_get(s, "$.codec_type", "string"))
    return parsed.withColumns(
        {
            "seconds": _get("$.format.duration", "string").try_cast("double"), "container_bit_rate": _get("$.format.bit_rate", "string").try_cast("long"),
            "has_audio": F.when(~F.col("malformed"), F.array_contains(F.array_compact(kinds), "audio")),
        }
    ).drop("_v")


def source_crf(probes: DataFrame, answer: str = "answer") -> DataFrame:
    """Adds malformed and crf: the crf=... that any text of a video track holds; of several the first by track, then by the name of its field."""
    parsed = _parsed(probes, answer)
    tracks = F.coalesce(_get("$.media.track", "array<variant>"), F.array().cast("array<variant>"))
    videos = F.filter(tracks, lambda t: F.coalesce(F.try_variant_get(t, "$['@type']", "string") == "Video", F.lit(False)))
    fields = F.flatten(F.transform(videos, lambda t: F.transform(F.array_sort(F.map_entries(F.try_variant_get(t, "$", "map<string,string>"))), lambda e: e["value"])))
    found = F.filter(F.transform(fields, lambda s: F.regexp_extract(F.coalesce(s, F.lit("")), r"\bcrf=(\d+\.?\d*)", 1)), lambda s: s != "")
    return parsed.withColumn("crf", F.get(found, F.lit(0)).try_cast("double")).drop("_v")


CANDIDATE_FIELDS = {
    "id": ("id", "long"), "track_name": ("trackName", "string"), "artist_name": ("artistName", "string"), "album_name": ("albumName", "string"), "duration": ("duration", "double"),
    "instrumental": ("instrumental", "boolean"), "plain_lyrics": ("plainLyrics", "string"), "synced_lyrics": ("syncedLyrics", "string"),
}


def search_candidates(answers: DataFrame, key: list[str], answer: str = "answer") -> DataFrame:
    """key, pos and the candidates' fields, one row a candidate of a list, or of a single one; answers that are neither have no row. Missing names are empty, instrumental false."""
    parsed = _parsed(answers, answer)
    listed = F.coalesce(_get("$", "array<variant>"), F.when(_get("$.id", "variant").isNotNull(), F.array("_v")))
    rows = parsed.select(*key, F.posexplode(listed).alias("pos", "_v"))
    given = {name: _get(f"$.{field}", kind) for name, (field, kind) in CANDIDATE_FIELDS.items()}
    given |= {n: F.coalesce(given[n], F.lit("")) for n in ("track_name", "artist_name", "album_name")} | {"instrumental": F.coalesce(given["instrumental"], F.lit(False))}
    return rows.where(F.try_variant_get("_v", "$", "map<string,variant>").isNotNull()).select(*key, "pos", *(c.alias(n) for n, c in given.items()))


def malformed_answers(answers: DataFrame, key: list[str], answer: str = "answer") -> DataFrame:
    """key and the answer of what is no JSON."""
    return _parsed(answers, answer).where("malformed").select(*key, answer)
