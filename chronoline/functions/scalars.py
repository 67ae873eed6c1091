"""Column functions for text, musical time and pitch; all stay in the JVM.

Unless a function says otherwise, a null argument gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTE_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
#: Words that lyrics add or leave out at will.
FILLERS = ("ooh", "ooo", "oh", "ohh", "mmm", "mm", "yeah", "and", "but")
#: Words that stay lower inside a title.
MINOR_WORDS = (
    "a", "an", "the", "and", "but", "or", "nor", "for", "so", "yet", "as", "at", "by", "in", "into", "of", "off", "on", "onto", "out", "over",
    "per", "to", "up", "via", "with", "from",
)
MIN_TEMPO, MAX_TEMPO = 60.0, 200.0
GOLDEN_SECONDS = 0.6


# text


def normalize_word(text: Column) -> Column:
    """Lower case, curly quotes as ', everything but [a-z0-9'] deleted."""
    return F.regexp_replace(F.translate(F.lower(text), "’‘", "''"), "[^a-z0-9']", "")


def normalize_edges(text: Column) -> Column:
    """Trimmed, lower case, without .,!?"' at either end."""
    return F.btrim(F.lower(F.btrim(text)), F.lit(".,!?\"'"))


def normalize_line(text: Column) -> Column:
    """Normalized words of a line, joined by single spaces; white space stays while the rest is normalized at once, and is folded then."""
    kept = F.regexp_replace(F.translate(F.lower(text), "’‘", "''"), r"[^a-z0-9'\s]", "")
    return F.btrim(F.regexp_replace(kept, r"\s+", " "))


def without_fillers(normalized_line: Column, fillers: tuple[str, ...] = FILLERS) -> Column:
    """Words of a normalized line that are no fillers, concatenated."""
    return F.array_join(F.filter(F.split(normalized_line, " "), lambda w: ~w.isin(*fillers)), "")


def loosely_equal(a: Column, b: Column) -> Column:
    """Both non-empty, and equal or one within the other."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def artist_matches(ours: Column, theirs: Column) -> Column:
    a, b = normalize_word(ours), normalize_word(theirs)
    return F.coalesce(loosely_equal(a, b), F.lit(False))


def case_shape(word: Column) -> Column:
    """none, simple (no letter upper but the first), upper (two letters or more, all upper) or mixed."""
    letters = F.regexp_replace(word, r"[^\p{L}]", "")
    rest = F.substr(letters, F.lit(2))
    return (
        F.when(letters == "", "none")
        .when((F.length(letters) > 1) & (letters == F.upper(letters)), "upper")
        .when(rest == F.lower(rest), "simple")
        .otherwise("mixed")
    )


def _capital(word: Column) -> Column:
    """The first letter in upper case, whatever stands before it."""
    head = F.regexp_extract(word, r"^([^\p{L}]*)", 1)
    at = F.length(head) + 1
    return F.concat(head, F.upper(F.substr(word, at, F.lit(1))), F.substr(word, at + 1))


def headline_case(text: Column, minor: tuple[str, ...] = MINOR_WORDS) -> Column:
    """Title case; minor words stay lower inside; acronyms and mixed case are kept."""
    words = F.split(text, " ")
    last = F.size(words) - 1

    def one(word: Column, i: Column) -> Column:
        low = F.lower(word)
        is_minor = (i > 0) & (i < last) & F.regexp_replace(low, r"[^\p{L}]", "").isin(*minor)
        return F.when(case_shape(word) != "simple", word).when(is_minor, low).otherwise(_capital(low))

    return F.array_join(F.transform(words, one), " ")


def safe_file_name(text: Column) -> Column:
    """Without <>:"/\\|?* anywhere, and without spaces and dots at the end."""
    return F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*]', ""), "[ .]+$", "")


def split_artist_title(name: Column) -> Column:
    """struct(artist, title) around the first ' - '; null without one."""
    parts = F.split(name, " - ", 2)
    return F.when(F.size(parts) == 2, F.struct(F.btrim(parts[0]).alias("artist"), F.btrim(F.get(parts, F.lit(1))).alias("title")))


def chunks_of(parts: Column, n: Column, separator: str = "") -> Column:
    """Array of strings merged into n even chunks, the first ones longer by one."""
    size, rest = F.floor(F.size(parts) / n).cast("int"), (F.size(parts) % n).cast("int")
    return F.transform(
        F.sequence(F.lit(0), n.cast("int") - 1),
        lambda c: F.array_join(F.slice(parts, c * size + F.least(c, rest) + 1, size + F.when(c < rest, 1).otherwise(0)), separator),
    )


def parse_decimal(text: Column) -> Column:
    """A number with a comma or a point; null if it is none."""
    return F.replace(F.btrim(text), F.lit(","), F.lit(".")).try_cast("double")


def parse_clock(text: Column) -> Column:
    """Seconds from 'ss', 'mm:ss' or 'hh:mm:ss', each with a fraction; null if it is none of them."""
    parts = F.transform(F.split(F.btrim(text), ":"), lambda p: p.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)
    return F.when((F.size(parts) <= 3) & F.btrim(text).rlike(r"^\d+(:\d{1,2}){0,2}(\.\d+)?$"), total)


def format_tempo(bpm: Column) -> Column:
    """Two decimals without trailing zeros and point."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", bpm), "0+$", ""), r"\.$", "")


def crc_text(content: Column) -> Column:
    """CRC32 of a binary or string column as eight hex digits."""
    return F.lower(F.lpad(F.hex(F.crc32(content)), 8, "0"))


def path_key(path: Column) -> Column:
    """A path without its drive, with forward slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^[A-Za-z]:/*", "")


# musical time


def beat_ms(bpm: Column) -> Column:
    return F.lit(60000.0) / (bpm * 4)


def seconds_to_beat(t: Column, gap_ms: Column, bpm: Column) -> Column:
    """Nearest beat, halves to even."""
    return F.bround((t * 1000.0 - gap_ms) / beat_ms(bpm)).cast("long")


def seconds_to_beats(duration: Column, bpm: Column) -> Column:
    """Whole beats of a duration, one at least."""
    return F.greatest(F.lit(1), F.floor(duration * 1000.0 / beat_ms(bpm))).cast("long")


def beat_to_seconds(beat: Column, gap_ms: Column, bpm: Column) -> Column:
    return (gap_ms + beat * beat_ms(bpm)) / 1000.0


def fold_tempo(bpm: Column, low: float = MIN_TEMPO, high: float = MAX_TEMPO) -> Column:
    """Doubled or halved into [low, high]; null for zero and less."""
    up = bpm * F.pow(F.lit(2.0), F.ceil(F.log2(F.lit(low) / bpm)))
    down = bpm / F.pow(F.lit(2.0), F.ceil(F.log2(bpm / high)))
    return F.when(bpm <= 0, None).when(bpm < low, up).when(bpm > high, down).otherwise(bpm)


# pitch (MIDI number less 60)


def hz_to_pitch(hz: Column) -> Column:
    return (F.bround(F.lit(69.0) + 12 * F.log2(hz / 440.0)) - 60).cast("int")


def pitch_name(pitch: Column) -> Column:
    midi = pitch + 60
    return F.concat(F.element_at(F.array(*map(F.lit, NOTE_NAMES)), (F.pmod(midi, 12) + 1).cast("int")), (F.floor(midi / 12) - 1).cast("string"))


def nearest_pitch_of_class(pitch: Column, target_class: Column) -> Column:
    """The closest pitch of a class, by -5 to +6 steps."""
    up = F.pmod(target_class - pitch, F.lit(12))
    return pitch + F.when(up > 6, up - 12).otherwise(up)


def note_type(duration: Column, golden: float = GOLDEN_SECONDS) -> Column:
    return F.when(duration >= golden, "*").otherwise(":")


def cents_to_class(cents: Column) -> Column:
    """Pitch class of a frequency given in cents over 10 Hz."""
    midi = F.lit(69.0) + 12 * F.log2(10 * F.pow(F.lit(2.0), cents / 1200) / 440.0)
    return F.pmod(F.bround(midi), F.lit(12)).cast("int")


# media


def bit_rate_for_crf(width: Column, height: Column, fps: Column, crf: Column) -> Column:
    """Bits a second that a CRF is expected to take."""
    return F.lit(0.1) * F.pow(F.lit(2.0), (F.lit(23) - crf) / 6.0) * width * height * fps


def image_kind(content: Column) -> Column:
    """jpg or png by magic bytes, null else."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(F.startswith(head, F.lit("FFD8FF")), ".jpg").when(F.startswith(head, F.lit("89504E470D0A1A0A")), ".png")


def effective_duration(claimed: Column, synced: Column, last_line: Column) -> Column:
    """Time of the last synced line where it is not under the claimed duration, else the claim."""
    has = claimed.isNotNull() & (F.coalesce(synced, F.lit("")) != "") & last_line.isNotNull()
    return F.when(has & (last_line >= claimed), last_line).otherwise(claimed)


def candidate_score(instrumental: Column, plain: Column, synced: Column, duration: Column, wanted: Column, window: float = 60.0) -> Column:
    """-1 unless there are plain and synced lyrics, else 1 less the share of the window that durations differ by; 0 if one is unknown."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    near = F.when(duration != 0, F.greatest(F.lit(0.0), 1 - F.abs(duration - wanted) / window))
    return F.when(F.coalesce(instrumental, F.lit(False)) | empty(plain) | empty(synced), F.lit(-1.0)).otherwise(F.coalesce(near, F.lit(0.0)))


def without_duet_mark(text: Column) -> Column:
    """Names and chart lines without the duet mark of a title."""
    return F.replace(text, F.lit(" [DUET]"), F.lit(""))
