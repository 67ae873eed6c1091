import base64
import random
import struct

import pytest
from chronoline.sources import media_bytes as M
from chronoline.sources import probes as B
from pyspark.sql import functions as F

IMAGE = b"\x89PNG" + bytes(range(256)) * 3


def test_video_facts_from_answers_of_all_kinds(spark):
    answers = [
        '{"streams":[{"width":1920,"height":1080,"r_frame_rate":"30000/1001","codec_name":"h264","bit_rate":"5000"}]}', '{"streams":[{"width":1,"r_frame_rate":"0/0"}]}',
        '{"streams":[]}', "{}", "", None, "{broken", '{"streams":[{"width":1,"bit_rate":"N/A"}]}', "[1]", '{"streams":[{"r_frame_rate":"25"}]}',
    ]
    df = spark.createDataFrame(list(enumerate(answers)), "k int, answer string")
    got = [tuple(r)[2:] for r in B.video_facts(df).orderBy("k").collect()]
    none = (None,) * 5
    assert got[0] == (False, 1920, 1080, pytest.approx(29.97, abs=0.01), "h264", 5000)
    assert got[1] == (False, 1, None, 0.0, None, None) and got[9] == (False, None, None, 25.0, None, None)
    assert got[2] == got[3] == got[7] == got[8] == (False, *none) and got[4] == got[5] == got[6] == (True, *none)


def test_crf_sound_and_candidates(spark):
    one = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "k int, answer string")
    crf = B.source_crf(one('{"media":{"track":[{"@type":"Audio","x":"crf=9"},{"@type":"Video","a":"rc=crf / crf=18.5 / q","n":3}]}}', '{"media":{"track":[{"@type":"Video"}]}}', "no", '{"media":{}}'))
    assert [(r["malformed"], r["crf"]) for r in crf.orderBy("k").collect()] == [(False, 18.5), (False, None), (True, None), (False, None)]
    facts = B.container_facts(one('{"format":{"duration":"12.5","bit_rate":"9"},"streams":[{"codec_type":"video"},{"codec_type":"audio"}]}', "{}", "x"))
    assert [tuple(r)[2:] for r in facts.orderBy("k").collect()] == [(False, 12.5, 9, True), (False, None, None, False), (True, None, None, None)]
    found = B.search_candidates(one('[{"id":1,"trackName":"a","duration":3,"extra":[]},{"id":2,"instrumental":true,"syncedLyrics":"[00:01.00]x"},7]', '{"id":5,"artistName":"z"}', '{"code":404}', "bad"), ["k"])
    assert [tuple(r) for r in found.orderBy("k", "pos").collect()] == [
        (0, 0, 1, "a", "", "", 3.0, False, None, None), (0, 1, 2, "", "", "", None, True, None, "[00:01.00]x"), (1, 0, 5, "", "z", "", None, False, None, None),
    ]


def syncsafe(n):
    return bytes(n >> 7 * k & 0x7F for k in (3, 2, 1, 0))


def id3(version, frames, flags=0, extra=b""):
    body = extra + b"".join(frames) + b"\0" * 20
    return b"ID3" + bytes([version, 0, flags]) + syncsafe(len(body)) + body + b"\xff\xfb sound"


def frame(version, name, body, marks=0):
    if version == 2:
        return name + len(body).to_bytes(3, "big") + body
    return name + (syncsafe(len(body)) if version == 4 else len(body).to_bytes(4, "big")) + bytes([0, marks]) + body


def block(image=IMAGE):
    part = lambda b: struct.pack(">I", len(b)) + b
    return struct.pack(">I", 3) + part(b"image/png") + part("é".encode()) + b"\0" * 16 + part(image)


def box(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def mp4(image=IMAGE):
    covers = box(b"covr", box(b"data", struct.pack(">II", 14, 0) + image))
    return box(b"ftyp", b"M4A ") + box(b"free", b"xx") + box(b"moov", box(b"mvhd", b"123") + box(b"udta", box(b"meta", b"\0" * 4 + box(b"hdlr", b"q") + box(b"ilst", box(b"\xa9nam", b"t") + covers))))


def ogg(packets, serial=b"abcd"):
    """Pages of at most 255 segments."""
    lengths = [n for p in packets for n in [255] * (len(p) // 255) + [len(p) % 255]]
    data, out, at = b"".join(packets), b"", 0
    for k in range(0, len(lengths), 255):
        own = lengths[k : k + 255]
        out += b"OggS\0\0" + b"\0" * 8 + serial + b"\0" * 8 + bytes([len(own)]) + bytes(own) + data[at : at + sum(own)]
        at += sum(own)
    return out


def comments(mark, *entries):
    return mark + struct.pack("<I", 2) + b"me" + struct.pack("<I", len(entries)) + b"".join(struct.pack("<I", len(e)) + e for e in entries)


ART = b"metadata_block_picture=" + base64.b64encode(block(IMAGE * 90))
APIC = b"\0image/png\0\3front\0" + IMAGE
FILES = {
    "v3": (id3(3, [frame(3, b"TIT2", b"\0x"), frame(3, b"APIC", APIC)]), IMAGE), "v4": (id3(4, [frame(4, b"APIC", b"\1image/png\0\3" + "é".encode("utf-16") + b"\0\0" + IMAGE)]), IMAGE),
    "v2": (id3(2, [frame(2, b"PIC", b"\0PNG\3x\0" + IMAGE)]), IMAGE), "v4 length": (id3(4, [frame(4, b"APIC", b"\0\0\0\1" + APIC, 0x01)]), IMAGE),
    "v3 extended": (id3(3, [frame(3, b"APIC", APIC)], 0x40, struct.pack(">I", 6) + b"\0" * 6), IMAGE), "no frame": (id3(3, [frame(3, b"TIT2", b"\0x")]), None),
    "flac": (b"fLaC\0\0\0\2ab\x86" + len(block()).to_bytes(3, "big") + block(), IMAGE), "mp4": (mp4(), IMAGE), "empty": (b"", None), "text": (b"no tag at all", None), "none": (None, None),
    "vorbis": (ogg([b"\1vorbis..", comments(b"\3vorbis", b"TITLE=x", ART)]), IMAGE * 90), "opus": (ogg([b"OpusHead", comments(b"OpusTags", ART)]), IMAGE * 90),
    "bad base64": (ogg([b"OpusHead", comments(b"OpusTags", b"METADATA_BLOCK_PICTURE=***")]), None),
}


def test_pictures_come_out_byte_for_byte(spark):
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, (v, _) in FILES.items()], "path_key string, content binary")
    got = {r["path_key"]: r["picture"] and bytes(r["picture"]) for r in M.embedded_pictures(df).collect()}
    assert got == {k: want for k, (_, want) in FILES.items()}


def test_broken_lengths_give_null_and_never_fail():
    r = random.Random(1)
    for name, (data, image) in FILES.items():
        for read in M.PICTURES.values():
            for cut in {0, 1, 5, 9, 11, *(r.randrange(len(data or b"") + 1) for _ in range(40))}:
                part = read((data or b"")[:cut])
                assert part is None or image is not None and part == image, (name, cut)
            for _ in range(60 if data else 0):
                broken = bytearray(data)
                broken[r.randrange(min(len(broken), 80))] = r.randrange(256)
                read(bytes(broken))


def walk(data, fraction, count=2):
    """The whole file, box by box."""
    target, at, moofs, spans = int(len(data) * fraction), 0, [], {}
    whole = True
    while at < len(data):
        head = M.box_header(data, at, len(data))
        if head is None:
            whole = False
            break
        if head[0] == b"moof":
            behind = M.box_header(data, at + head[2], len(data))
            spans[at] = head[2] + (behind[2] if behind else 0)
            moofs.append(at)
        at += head[2]
    before, after = [m for m in moofs if m <= target], [m for m in moofs if m > target]
    if not before or not (whole or after):
        return None
    end = begin = before[-1]
    for _ in range(count):
        if end >= len(data) or end not in spans:
            break
        end += spans[end]
    return moofs[0], begin, min(end, len(data)) - begin


def test_fragments_near_equal_a_full_walk(spark):
    r = random.Random(3)
    files = []
    for _ in range(60):
        parts = [box(b"ftyp", b"x" * r.randint(0, 30)), box(b"moov", b"y" * r.randint(0, 200))]
        for _ in range(r.randint(0, 9)):
            parts += [box(b"moof", b"m" * r.randint(0, 40)), *([box(b"mdat", b"d" * r.randint(0, 400))] if r.random() < 0.9 else []), *([box(b"free", b"")] if r.random() < 0.2 else [])]
        data = b"".join(parts)
        if r.random() < 0.2:
            data += r.choice([b"\0\0", struct.pack(">I4s", 3, b"mdat"), struct.pack(">I4s", 0, b"mdat") + b"rest", struct.pack(">I4sQ", 1, b"moof", 40)])
        files.append(data[: r.randrange(len(data))] if r.random() < 0.2 else data)
    df = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(files)], "path_key int, content binary")
    boxes = M.media_boxes(df)
    for fraction in (0.0, 0.3, 0.5, 0.9, 1.0):
        got = {x["path_key"]: tuple(x)[1:] for x in M.fragments_near(boxes, F.lit(fraction)).collect()}
        assert got == {k: w for k, d in enumerate(files) if (w := walk(d, fraction)) is not None}
