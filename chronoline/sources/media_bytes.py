"""Pictures in sound files and boxes in video files, from whole files as binary rows (path_key, content), as spark.read.format("binaryFile") gives them.

Only reading headers is Python, one file at a time and never past a length that the file itself has; what follows from them is DataFrame work.
"""

from __future__ import annotations

import base64
import binascii
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fragments taken from the located one on.
FRAGMENTS = 2


# pictures


def _syncsafe(b: bytes) -> int:
    return sum((x & 0x7F) << 7 * (3 - k) for k, x in enumerate(b))


def _image_behind_text(body: bytes, skip_type: bool) -> bytes | None:
    """The image of a picture frame: encoding, format (a terminated text, or three letters), kind, description in the encoding, image."""
    encoding, rest = body[0], body[1:]
    if skip_type:
        end = rest.find(b"\0")
        if end < 0:
            return None
        rest = rest[end + 1 :]
    else:
        rest = rest[3:]
    rest = rest[1:]
    if encoding in (1, 2):  # two bytes a letter
        at = next((i for i in range(0, len(rest) - 1, 2) if rest[i : i + 2] == b"\0\0"), None)
        return None if at is None else rest[at + 2 :]
    at = rest.find(b"\0")
    return None if at < 0 else rest[at + 1 :]


def id3_picture(data: bytes) -> bytes | None:
    """First picture of an ID3v2 tag (versions 2 to 4) at the start of the file."""
    if len(data) < 10 or data[:3] != b"ID3" or data[3] not in (2, 3, 4):
        return None
    version, flags, size = data[3], data[5], _syncsafe(data[6:10])
    if 10 + size > len(data):
        return None
    tag = data[10 : 10 + size]
    if flags & 0x80 and version < 4:
        tag = tag.replace(b"\xff\x00", b"\xff")
    if flags & 0x40 and version > 2 and len(tag) >= 4:
        tag = tag[_syncsafe(tag[:4]) :] if version == 4 else tag[4 + int.from_bytes(tag[:4], "big") :]
    at, head, letters = 0, (6 if version == 2 else 10), (3 if version == 2 else 4)
    while at + head <= len(tag) and tag[at] != 0:
        name = tag[at : at + letters]
        size = int.from_bytes(tag[at + 3 : at + 6], "big") if version == 2 else _syncsafe(tag[at + 4 : at + 8]) if version == 4 else int.from_bytes(tag[at + 4 : at + 8], "big")
        body = tag[at + head : at + head + size]
        if len(body) < size:
            return None
        if name in (b"APIC", b"PIC") and body:
            marks = tag[at + 9] if version > 2 else 0
            if version == 4 and marks & 0x01:
                body = body[4:]
            if version == 4 and marks & 0x02:
                body = body.replace(b"\xff\x00", b"\xff")
            return (_image_behind_text(body, version > 2) or None) if body else None
        at += head + size
    return None


def picture_block(block: bytes) -> bytes | None:
    """The image of a FLAC picture block."""
    at = 4
    for _ in range(2):  # format, description
        if at + 4 > len(block):
            return None
        at += 4 + int.from_bytes(block[at : at + 4], "big")
    at += 16
    if at + 4 > len(block):
        return None
    size = int.from_bytes(block[at : at + 4], "big")
    return block[at + 4 : at + 4 + size] or None if at + 4 + size <= len(block) else None


def flac_picture(data: bytes) -> bytes | None:
    if data[:4] != b"fLaC":
        return None
    at, last = 4, False
    while not last and at + 4 <= len(data):
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        if kind == 6:
            return picture_block(data[at + 4 : at + 4 + size])
        at += 4 + size
    return None


def box_header(data: bytes, at: int, end: int) -> tuple[bytes, int, int] | None:
    """(type, header bytes, whole bytes) of the box there; null where it does not fit its own header."""
    if at + 8 > end:
        return None
    size, kind = struct.unpack_from(">I4s", data, at)
    head = 8
    if size == 1:
        if at + 16 > end:
            return None
        size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
    elif size == 0:
        size = end - at
    return None if size < head else (kind, head, size)


def _inside(data: bytes, begin: int, end: int, kind: bytes) -> tuple[int, int] | None:
    """Where the first box of a kind has its content, among the boxes from begin to end."""
    at = begin
    while (box := box_header(data, at, end)) is not None and at + box[2] <= end:
        if box[0] == kind:
            return at + box[1], at + box[2]
        at += box[2]
    return None


def mp4_picture(data: bytes) -> bytes | None:
    """First cover of the list of tags in the movie box."""
    if data[4:8] != b"ftyp":
        return None
    span: tuple[int, int] | None = (0, len(data))
    for kind in (b"moov", b"udta", b"meta", b"ilst", b"covr", b"data"):
        span = _inside(data, *span, kind)
        if span is None:
            return None
        if kind == b"meta":
            span = span[0] + 4, span[1]
    return data[span[0] + 8 : span[1]] or None


def _ogg_packets(data: bytes, most: int = 2) -> list[bytes]:
    """The first packets of the first stream."""
    packets, part, at, serial = [], b"", 0, None
    while len(packets) < most and data[at : at + 4] == b"OggS" and at + 27 <= len(data):
        own, count = data[at + 14 : at + 18], data[at + 26]
        lengths = data[at + 27 : at + 27 + count]
        body = at + 27 + count
        if len(lengths) < count or body + sum(lengths) > len(data):
            break
        serial = own if serial is None else serial
        for n in lengths if own == serial else ():
            part += data[body : body + n]
            body += n
            if n < 255:
                packets.append(part)
                part = b""
        at += 27 + count + sum(lengths)
    return packets[:most]


def ogg_picture(data: bytes) -> bytes | None:
    """The picture that the comments of an Ogg stream hold as text."""
    packets = _ogg_packets(data)
    if len(packets) < 2:
        return None
    comment = next((packets[1][len(m) :] for m in (b"\x03vorbis", b"OpusTags") if packets[1].startswith(m)), None)
    if comment is None or len(comment) < 4:
        return None
    at = 4 + int.from_bytes(comment[:4], "little")
    count = int.from_bytes(comment[at : at + 4], "little")
    at += 4
    for _ in range(count):
        size = int.from_bytes(comment[at : at + 4], "little")
        entry = comment[at + 4 : at + 4 + size]
        if at + 4 > len(comment) or len(entry) < size:
            return None
        name, _, value = entry.partition(b"=")
        if name.upper() == b"METADATA_BLOCK_PICTURE":
            try:
                return picture_block(base64.b64decode(value, validate=True))
            except binascii.Error:
                return None
        at += 4 + size
    return None


PICTURES = {"id3": id3_picture, "mp4": mp4_picture, "flac": flac_picture, "ogg": ogg_picture}


def embedded_pictures(files: DataFrame) -> DataFrame:
    """path_key, container (whose tags held it) and picture: the first embedded picture of each file; null without one, or where a length does not fit the file."""
    source = files.select("path_key", "content")
    kind = source.schema["path_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for content in batch.column(1):
                data = content.as_py() or b""
                found.append(next(((name, p) for name, read in PICTURES.items() if (p := read(data))), (None, None)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], names=["path_key", "container", "picture"])

    return source.mapInArrow(run, f"path_key {kind}, container string, picture binary")


# boxes


def media_boxes(files: DataFrame) -> DataFrame:
    """path_key, total, box_no, box_type, offset, bytes, readable: the outermost boxes of each file in order; the last row of a file that breaks off is not readable and has no type."""
    source = files.select("path_key", "content")
    kind = source.schema["path_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, content in enumerate(batch.column(1)):
                data = content.as_py() or b""
                offset = number = 0
                while offset < len(data):
                    box = box_header(data, offset, len(data))
                    at.append(k)
                    rows.append((len(data), number, None if box is None else box[0].decode("latin-1"), offset, 0 if box is None else box[2], box is not None))
                    if box is None:
                        break
                    offset, number = offset + box[2], number + 1
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["path_key", "total", "box_no", "box_type", "offset", "bytes", "readable"])

    return source.mapInArrow(run, f"path_key {kind}, total bigint, box_no bigint, box_type string, offset bigint, bytes bigint, readable boolean")


def fragments_near(boxes: DataFrame, fraction: Column, count: int = FRAGMENTS) -> DataFrame:
    """path_key, init_bytes, fragment_offset, fragment_bytes: what lies before the first fragment, and up to so many fragments from the last one that begins at or before the fraction of the file.

    A fragment is a moof box and the box behind it. Files without one by then, and files that break off before a fragment behind the fraction, have no row.
    """
    w = Window.partitionBy("path_key").orderBy("box_no")
    moof = F.col("readable") & (F.col("box_type") == "moof")
    target = F.floor(F.col("total") * fraction)
    indexed = boxes.withColumns({"_span": F.when(moof, F.col("bytes") + F.coalesce(F.lead(F.when(F.col("readable"), F.col("bytes"))).over(w), F.lit(0))), "_target": target})
    at = lambda cond, f: f(F.when(moof & cond, F.col("offset")))
    chosen = indexed.groupBy("path_key").agg(
        at(F.lit(True), F.min).alias("init_bytes"), at(F.col("offset") <= F.col("_target"), F.max).alias("fragment_offset"),
        at(F.col("offset") > F.col("_target"), F.min).alias("_behind"), F.max("total").alias("_total"), F.min(F.when(~F.col("readable"), F.col("offset"))).alias("_broken"),
    ).where(F.col("fragment_offset").isNotNull() & (F.col("_broken").isNull() | F.col("_behind").isNotNull()))
    # each further fragment begins where the one before it ends
    spans = indexed.where(moof).select(F.col("path_key").alias("_key"), F.col("offset").alias("_at"), "_span")
    taken = chosen.withColumns({"_next": F.col("fragment_offset"), "fragment_bytes": F.lit(0).cast("long")})
    for _ in range(count):
        step = F.coalesce(F.when(F.col("_next") < F.col("_total"), F.col("_span")), F.lit(0))
        taken = taken.join(spans, (F.col("path_key") == F.col("_key")) & (F.col("_next") == F.col("_at")), "left").drop("_key")
        taken = taken.withColumns({"fragment_bytes": F.col("fragment_bytes") + step, "_next": F.when(F.col("_span").isNotNull(), F.col("_next") + step)}).drop("_at", "_span")
    length = F.least(F.col("fragment_bytes"), F.col("_total") - F.col("fragment_offset"))
    return taken.select("path_key", "init_bytes", "fragment_offset", length.alias("fragment_bytes"))
