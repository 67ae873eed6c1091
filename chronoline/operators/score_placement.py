"""Charts from sheet music and a timed lyric: lines and texts for a score's words, their places in time by heard words, their syllables.

words(song_id, pos, text, norm, offset, syllables array<struct<off, qlen, midi, text>>) are a score's sung words (sources.scores.sung_words),
pos counts from 0, an untexted syllable is ~. lines(song_id, line_no, t, line) is a calibrated lyric. The alignments run a song or a line at
a time in grouped functions; blocks, slots, interpolation and clamps are DataFrame work.

Cases: a song without lines has no rows; words before the first matched one take its line; lines of marks only have no tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline.functions import scalars as S
from chronoline.functions.syllables import syllables
from chronoline.operators import alignment as A
from chronoline.operators import ordered as O
from chronoline.operators import placement as P
from chronoline.operators import ranges as R
from chronoline.operators import retiming as RT
from chronoline.session import checkpoint

KEY, ORDER, TAIL = ["song_id"], ["pos"], "~"
MIN_RATIO, BLOCK_WORDS, QUARTER_SECONDS = 0.6, 6, 0.3
_SHOWN = "array<struct<text: string, is_word_start: boolean>>"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _weights(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.greatest(F.lit(1), F.length(t)).cast("double"))


def _hyphen_pieces(token: Column) -> Column:
    """The pieces between hyphens, or the token where there is none."""
    pieces = F.filter(F.split(token, "-"), lambda p: p != "")
    return F.when(token.contains("-") & (F.size(pieces) > 0), pieces).otherwise(F.array(token))


def slots(tokens: Column, parts: Column, slot_texts: Column) -> Column:
    """Texts for exactly as many slots as slot_texts: hyphens split, one word cut by the slots' lengths or into its parts, words merged, ~ to fill up."""
    n = F.size(slot_texts)
    loose = F.when(F.size(tokens) < n, F.flatten(F.transform(tokens, _hyphen_pieces))).otherwise(tokens)
    cut = P.slice_text(F.get(loose, F.lit(0)), _weights(slot_texts))
    fewer = F.when(F.size(parts) > n, S.chunks_of(parts, n)).otherwise(parts)
    lone = (F.size(loose) == 1) & (n > 1)
    found = F.when(lone, F.coalesce(cut, fewer)).otherwise(loose)
    merged = F.when(F.size(found) > n, S.chunks_of(found, n, " ")).otherwise(found)
    return F.concat(merged, F.array_repeat(F.lit(TAIL), F.greatest(F.lit(0), n - F.size(merged))))


def _tokens(lines: DataFrame) -> DataFrame:
    """song_id, pos, raw, norm, line_no of every token of the lines."""
    # normalized before the rows are made: a filter on a text worked out behind them would work it out twice
    both = F.transform(F.split(F.btrim("line"), r"\s+"), lambda raw: F.struct(raw.alias("raw"), S.normalize_word(raw).alias("norm")))
    tokens = lines.select("song_id", "line_no", F.posexplode(both).alias("at", "t")).select("song_id", "line_no", "at", "t.*").where("norm <> ''")
    return tokens.select("song_id", (F.row_number().over(O.over(KEY, ["line_no", "at"])) - 1).cast("long").alias("pos"), "raw", "norm", "line_no")


def _with_parts(tokens: DataFrame) -> DataFrame:
    """Tokens with parts: their hyphen pieces or their syllables."""
    hyphened = _hyphen_pieces(F.col("raw"))
    split = tokens.withColumn("_split", syllables("raw"))
    return split.withColumn("parts", F.when(F.col("raw").contains("-") & (hyphened != F.array("raw")), hyphened).otherwise(F.col("_split"))).drop("_split")


def line_tokens(lines: DataFrame) -> DataFrame:
    """song_id, pos, raw, norm, line_no, parts of every token of the lines; parts are its hyphen pieces or its syllables."""
    return _with_parts(_tokens(lines))


def _spread(blocks: DataFrame, rows: DataFrame, low: str, high: str) -> DataFrame:
    """The rows of each block."""
    spread = blocks.where(F.col(high) > F.col(low)).select("song_id", "i0", "j0", F.explode(F.sequence(F.col(low), F.col(high) - 1)).alias("pos"))
    return spread.join(rows, ["song_id", "pos"])


def _gathered(rows: DataFrame, item: Column, name: str) -> DataFrame:
    return rows.groupBy("song_id", "i0", "j0").agg(F.sort_array(F.collect_list(item)).alias(name))


def _flat_syllables(ours: Column) -> Column:
    """struct(word, syllable, text) of the texted syllables of a block's words."""
    each = F.transform(ours, lambda w, i: F.transform(w["syllables"], lambda s, k: F.struct(i.alias("word"), k.alias("syl"), s["text"].alias("text"))))
    return F.filter(F.flatten(each), lambda s: s["text"].isNotNull() & (s["text"] != TAIL))


def lines_for_words(words: DataFrame, lines: DataFrame) -> DataFrame:
    """words with line_no, clean_text, candidate, grp, grp_text, shown and, where a word was cut up, new syllables.

    Equal words and lone pairs that are alike take a token's text; a lone pair that is not keeps the token as a candidate. A short block that is alike
    as a whole takes the tokens syllable by syllable if each pair is alike (shown), cuts a lone word's time among several tokens, or fills its words
    as slots; a block of several words for one token is a group that is to be heard as one. Lines fill forward, at the start backward.
    """
    tokens = checkpoint(_tokens(lines))
    blocks = checkpoint(A.match_blocks(words, tokens, KEY, "norm", "norm").where("tag in ('equal', 'replace')"))
    same = blocks.where("tag = 'equal'").select("song_id", F.posexplode(F.sequence(F.col("i0"), F.col("i1") - 1)).alias("k", "pos"), "j0")
    same = same.select("song_id", "pos", (F.col("j0") + F.col("k")).alias("j")).join(tokens.withColumnRenamed("pos", "j"), ["song_id", "j"])
    same = same.select("song_id", "pos", "line_no", F.col("raw").alias("clean_text"))
    short = blocks.where(f"tag = 'replace' and i1 - i0 <= {BLOCK_WORDS} and j1 - j0 <= {BLOCK_WORDS}")
    ours = _gathered(_spread(short, words, "i0", "i1"), F.struct("pos", "norm", "text", "syllables"), "ours")
    told = _with_parts(_spread(short, tokens, "j0", "j1"))  # only tokens of short blocks are split
    theirs = _gathered(told, F.struct("pos", "norm", "raw", "line_no", "parts"), "theirs")
    met = ours.join(theirs, ["song_id", "i0", "j0"]).withColumns({"n": F.size("ours"), "m": F.size("theirs")})
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["norm"]), "")
    met = met.withColumn("_ratio", A.text_ratio(joined("ours"), joined("theirs")))
    alike, pair, lone = F.col("_ratio") >= MIN_RATIO, (F.col("n") == 1) & (F.col("m") == 1), F.col("m") == 1
    token = F.get("theirs", F.lit(0))
    raws = F.transform("theirs", lambda t: t["raw"])
    met = met.withColumn("_flat", _flat_syllables(F.col("ours")))
    cut = F.coalesce(P.slice_text(token["raw"], _weights(F.transform("_flat", lambda s: s["text"]))), F.array().cast("array<string>"))
    parts = F.flatten(F.transform("theirs", lambda t: F.transform(t["parts"], lambda p, i: F.struct(p.alias("text"), (i == 0).alias("is_word_start")))))
    target = F.when(lone, F.transform(cut, lambda p, i: F.struct(p.alias("text"), (i == 0).alias("is_word_start")))).otherwise(parts)
    met = checkpoint(met.withColumn("_target", target))
    norms = lambda c: F.transform(c, lambda x: S.normalize_word(x["text"]))
    by_syllable = F.coalesce(A.least_ratio(norms("_flat"), norms("_target")) >= MIN_RATIO, F.lit(False))
    met = met.withColumn("_how", F.when(pair, F.when(alike, "pair").otherwise("candidate")).when(~alike, None).when(by_syllable, "syllables").when(F.col("n") == 1, "cut").otherwise("slots"))
    met = met.where("_how is not null").withColumn("_slots", slots(raws, token["parts"], F.transform("ours", lambda w: w["text"])))
    each = met.select("*", F.posexplode("ours").alias("k", "w"))
    how = lambda name: F.col("_how") == name
    own = F.filter(F.arrays_zip("_flat", "_target"), lambda z: z["_flat"]["word"] == F.col("k"))
    tail = F.struct(F.lit(TAIL).alias("text"), F.lit(False).alias("is_word_start"))
    at = lambda i: F.get(F.filter(own, lambda z: z["_flat"]["syl"] == i), F.lit(0))["_target"]
    texted = F.exists("_flat", lambda s: s["word"] == F.col("k"))
    by_parts = F.when(texted, F.transform(F.col("w")["syllables"], lambda s, i: F.coalesce(at(i), tail)))
    first, last = F.get(F.col("w")["syllables"], F.lit(0)), F.element_at(F.col("w")["syllables"], -1)
    ends = P.slice_span(first["off"], last["off"] + last["qlen"] - first["off"], _weights(F.transform("_target", lambda s: s["text"])))
    begin = lambda i: F.when(i == 0, first["off"]).otherwise(F.get(ends, i - 1))
    recut = F.transform("_target", lambda s, i: F.struct(begin(i).alias("off"), (F.get(ends, i) - begin(i)).alias("qlen"), first["midi"].alias("midi"), s["text"].alias("text")))
    grouped = lone & (F.col("n") > 1) & ~how("candidate")
    changed = each.select(
        "song_id", F.col("w")["pos"].alias("pos"), F.when(~how("candidate"), token["line_no"]).alias("line_no"),
        F.when(how("pair"), token["raw"]).when(how("slots"), F.get("_slots", F.col("k"))).alias("clean_text"), F.when(how("candidate"), token["raw"]).alias("candidate"),
        F.when(grouped, F.col("i0")).alias("grp"), F.when(grouped, token["raw"]).alias("grp_text"),
        F.when(how("syllables"), by_parts).when(how("cut"), F.col("_target")).cast(_SHOWN).alias("shown"),
        F.when(how("cut"), recut).cast(words.schema["syllables"].dataType.simpleString()).alias("_recut"),
    )
    found = changed.unionByName(same, allowMissingColumns=True)
    out = words.join(found, ["song_id", "pos"], "left").join(lines.select("song_id").distinct(), "song_id", "left_semi")
    out = out.withColumns({"syllables": F.coalesce("_recut", "syllables"), "grp": F.coalesce("grp", "pos")}).drop("_recut")
    return out.withColumn("line_no", O.fill_forward("line_no", KEY, ORDER))


def place_words(words: DataFrame, lines: DataFrame, heard: DataFrame) -> DataFrame:
    """words of lines_for_words with start, end, placed_by (heard, rate or line) and pushed.

    Groups are heard as one word and share its time by their quarters; then each line's words are looked for in its own time, a candidate that is
    heard becomes the text. The others go at the rate of the two anchors around them, of the last or the next two, or at their line's own, inside
    their line. Starts never fall back (pushed), ends never pass the next start.
    """
    timed = R.line_windows(lines.select("song_id", "line_no", "t"), KEY, ["line_no"], "t")
    quarters = _sum(F.transform("syllables", lambda s: s["qlen"]))
    words = checkpoint(words.withColumn("quarters", quarters))
    grouped = words.where("grp_text is not null and line_no is not null")
    heads = grouped.where("pos = grp").join(timed, ["song_id", "line_no"]).select("song_id", "pos", F.col("grp").alias("line_no"), F.col("grp_text").alias("text"), "t", "t_end")
    as_one = RT.heard_in_lines(heads.where(S.normalize_word(F.col("text")) != ""), heads.select("song_id", "line_no", "t", "t_end"), heard, KEY).withColumnRenamed("pos", "grp")
    of_group = Window.partitionBy("song_id", "grp").orderBy("pos")
    whole = Window.partitionBy("song_id", "grp")
    shared = grouped.withColumns({"_all": F.sum("quarters").over(whole), "_n": F.count("*").over(whole), "_upto": F.sum("quarters").over(of_group)}).join(as_one, ["song_id", "grp"])
    span = F.when(F.col("heard_end") > F.col("heard_start"), F.col("heard_end") - F.col("heard_start")).otherwise(F.col("_all") * QUARTER_SECONDS)
    part = lambda q: F.col("heard_start") + F.when(F.col("_all") > 0, span * q / F.col("_all")).otherwise(0.0)
    shared = shared.select("song_id", "pos", part(F.col("_upto") - F.col("quarters")).alias("a"), part(F.col("_upto")).alias("ae"))
    rest = words.join(shared.select("song_id", "pos"), ["song_id", "pos"], "left_anti")
    sought = rest.withColumn("text", F.coalesce(F.nullif("clean_text", F.lit("")), F.nullif("candidate", F.lit("")), "text")).select("song_id", "pos", "line_no", "text")
    single = RT.heard_in_lines(sought, timed, heard, KEY).join(rest.select("song_id", "pos", "quarters"), ["song_id", "pos"])
    until = F.when(F.col("heard_end") > F.col("heard_start"), F.col("heard_end")).otherwise(F.col("heard_start") + F.col("quarters") * QUARTER_SECONDS)
    single = single.select("song_id", "pos", F.col("heard_start").alias("a"), until.alias("ae"), F.lit(True).alias("_single"))
    anchors = checkpoint(shared.unionByName(single, allowMissingColumns=True))
    both = words.join(anchors, ["song_id", "pos"], "left").join(timed, ["song_id", "line_no"])
    both = both.withColumn("clean_text", F.when(F.col("_single"), F.coalesce(F.nullif("clean_text", F.lit("")), "candidate")).otherwise(F.col("clean_text"))).drop("_single")
    point = F.when(F.col("a").isNotNull(), F.struct(F.col("offset").alias("o"), F.col("a").alias("s")))
    prior = lambda c: F.last(c, True).over(O.before(KEY, ORDER))
    later = lambda c: F.last(c, True).over(O.after(KEY, ORDER))
    both = both.withColumns({"_p": prior(point), "_n": later(point)})
    far = lambda c: F.when(F.col("a").isNotNull(), F.struct(F.col(c)["o"].alias("o"), F.col(c)["s"].alias("s")))
    both = both.withColumns({"_pp": prior(far("_p")), "_nn": later(far("_n"))})
    slope = lambda x, y: F.when(F.col(y)["o"] > F.col(x)["o"], (F.col(y)["s"] - F.col(x)["s"]) / (F.col(y)["o"] - F.col(x)["o"]))
    has = lambda c: F.col(c).isNotNull()
    rate = F.when(has("_p") & has("_n"), slope("_p", "_n")).when(has("_p"), slope("_pp", "_p")).when(has("_n"), slope("_n", "_nn"))
    base = F.coalesce("_p", "_n")
    line = Window.partitionBy("song_id", "line_no")
    low, width = F.min("offset").over(line), F.max("offset").over(line) - F.min("offset").over(line)
    both = both.withColumns({"_rate": rate, "_low": low, "_width": width})
    room = F.col("t_end") - F.col("t")
    by_line = F.col("t") + F.when(F.col("_width") > 0, (F.col("offset") - F.col("_low")) / F.col("_width")).otherwise(0.0) * room
    guess = F.coalesce(base["s"] + (F.col("offset") - base["o"]) * F.col("_rate"), by_line)
    inside = F.greatest(F.col("t"), F.least(guess, F.col("t_end")))
    pace = F.coalesce("_rate", F.when(F.col("_width") > 0, room / F.col("_width")), F.lit(QUARTER_SECONDS))
    pace = F.when(pace > 0, pace).otherwise(QUARTER_SECONDS)
    placed_by = F.when(has("a"), "heard").when(has("_rate"), "rate").otherwise("line")
    both = both.withColumns({"_s": F.coalesce("a", inside), "_e": F.coalesce("ae", inside + F.col("quarters") * pace), "placed_by": placed_by})
    both = both.withColumn("start", F.max("_s").over(O.upto(KEY, ORDER))).withColumn("pushed", F.col("start") > F.col("_s"))
    end = F.greatest("start", F.least("_e", F.lead("start").over(O.over(KEY, ORDER))))
    return both.withColumn("end", end).select(*[c for c in words.columns if c != "clean_text"], "clean_text", "start", "end", "placed_by", "pushed")


def placement_quality(placed: DataFrame) -> DataFrame:
    """song_id, words, heard, guessed, pushed, heard_rate of place_words."""
    count = lambda c: F.sum(c.cast("long"))
    by = F.col("placed_by") == "heard"
    counted = placed.groupBy("song_id").agg(F.count("*").alias("words"), count(by).alias("heard"), count(~by).alias("guessed"), count(F.col("pushed")).alias("pushed"))
    return counted.withColumn("heard_rate", F.col("heard") / F.col("words"))


def shown_texts(clean: Column, parts: Column, syllable_texts: Column) -> Column:
    """A text a syllable: the score's own where the texts agree or cannot be the same word, else the clean text over the texted syllables, ~ for the rest."""
    own = F.transform(syllable_texts, lambda t: F.coalesce(F.nullif(t, F.lit("")), F.lit(TAIL)))
    real = F.filter(F.transform(own, lambda t, i: F.when(t != TAIL, i)), lambda i: i.isNotNull())
    joined = S.normalize_word(F.array_join(F.filter(own, lambda t: t != TAIL), ""))
    n = F.size(real)
    weights = F.transform(real, lambda i: F.length(F.get(own, i)).cast("double"))
    pieces = F.coalesce(P.slice_text(clean, weights), F.when(F.size(parts) > n, S.chunks_of(parts, n)).otherwise(parts))
    spread = F.transform(own, lambda _, i: F.when(F.array_contains(real, i), F.coalesce(F.get(pieces, F.greatest(F.lit(0), F.array_position(real, i).cast("int") - 1)), F.lit(TAIL))).otherwise(TAIL))
    whole = F.transform(own, lambda _, i: F.when(i == F.coalesce(F.get(real, F.lit(0)), F.lit(0)), clean).otherwise(TAIL))
    same = (joined != "") & (joined == S.normalize_word(clean))
    left = clean.isNotNull() & ~same & (n > 1)  # the others are decided without a ratio
    unlike = clean.rlike(r"\s") | (A.text_ratio(F.when(left, joined), F.when(left, S.normalize_word(clean))) < MIN_RATIO)
    return F.when(clean.isNull() | same, own).when(n <= 1, whole).when(unlike, own).otherwise(spread)


def score_syllables(placed: DataFrame) -> DataFrame:
    """song_id, pos, k, text, start, end, pitch, is_word_start, line_no: a placed word's time shared by its notes' offsets."""
    texts = placed.withColumn("_own", F.transform("syllables", lambda s: s["text"]))
    several = F.size(F.filter("_own", lambda t: t.isNotNull() & ~t.isin("", TAIL))) > 1
    texts = texts.withColumn("_parts", syllables(F.when(several, F.col("clean_text"))))  # a lone syllable takes its word whole
    texts = texts.withColumn("_shown", shown_texts(F.col("clean_text"), F.col("_parts"), F.col("_own")))
    plain = F.transform("_shown", lambda t, i: F.struct(t.alias("text"), (i == 0).alias("is_word_start")))
    pairs = F.arrays_zip(F.col("syllables").alias("s"), F.coalesce("shown", plain).alias("d"))
    rows = texts.withColumn("_first", F.get("syllables", F.lit(0))["off"]).select("*", F.posexplode(pairs).alias("k", "z")).where("z.s is not null and z.d is not null")
    share = lambda o, none: F.when(F.col("quarters") > 0, (o - F.col("_first")) / F.col("quarters")).otherwise(none)
    width = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    off, stop = F.col("z.s.off"), F.col("z.s.off") + F.col("z.s.qlen")
    return rows.select(
        "song_id", "pos", "k", F.col("z.d.text").alias("text"), (F.col("start") + share(off, 0.0) * width).alias("_from"), (F.col("start") + share(stop, 1.0) * width).alias("_to"),
        (F.col("z.s.midi") - 60).cast("long").alias("pitch"), F.col("z.d.is_word_start").alias("is_word_start"), "line_no",
    ).withColumnsRenamed({"_from": "start", "_to": "end"})


MIN_HEARD_RATE, MAX_PUSHED_RATE = 0.5, 0.1


def chart_from_score(words: DataFrame, lines: DataFrame, heard: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(syllables, quality) of all songs; syllables only of songs where half the words were heard and a tenth at most had to be pushed."""
    placed = checkpoint(place_words(lines_for_words(words, lines), lines, heard))
    quality = placement_quality(placed).withColumn("accepted", (F.col("heard_rate") >= MIN_HEARD_RATE) & (F.col("pushed") <= F.col("words") * MAX_PUSHED_RATE))
    return score_syllables(placed.join(quality.where("accepted"), "song_id", "left_semi")), quality
