"""Time and pitch calibration of a song in tiers, from candidates to a correction that can be joined.

A correction is a table of anchors (x, y): a constant or a drift needs two, the later tiers as many as they found;
``estimators.interpolate`` applies any of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoline.operators import estimators as E
from chronoline.operators import notes as N
from chronoline.operators import ordered as O
from chronoline.session import checkpoint

#: How likely each class (column) is in each key (row).
KEY_TABLE = (
    (0.19, 0.0, 0.21, 0.0, 0.21, 0.08, 0.0, 0.13, 0.0, 0.11, 0.0, 0.07),
    (0.09, 0.21, 0.0, 0.17, 0.0, 0.18, 0.08, 0.0, 0.13, 0.0, 0.14, 0.0),
    (0.0, 0.07, 0.19, 0.0, 0.18, 0.0, 0.17, 0.08, 0.0, 0.19, 0.0, 0.12),
    (0.11, 0.0, 0.1, 0.26, 0.0, 0.16, 0.0, 0.17, 0.07, 0.0, 0.13, 0.0),
    (0.0, 0.14, 0.0, 0.07, 0.28, 0.0, 0.17, 0.0, 0.13, 0.06, 0.0, 0.15),
    (0.15, 0.0, 0.16, 0.0, 0.13, 0.17, 0.0, 0.16, 0.0, 0.13, 0.1, 0.0),
    (0.0, 0.15, 0.0, 0.16, 0.0, 0.12, 0.17, 0.0, 0.14, 0.0, 0.14, 0.12),
    (0.09, 0.0, 0.16, 0.0, 0.16, 0.0, 0.11, 0.17, 0.0, 0.16, 0.0, 0.15),
    (0.18, 0.07, 0.0, 0.15, 0.0, 0.14, 0.0, 0.09, 0.19, 0.0, 0.18, 0.0),
    (0.0, 0.18, 0.1, 0.0, 0.14, 0.0, 0.15, 0.0, 0.1, 0.17, 0.0, 0.16),
    (0.13, 0.0, 0.15, 0.09, 0.0, 0.16, 0.0, 0.18, 0.0, 0.12, 0.17, 0.0),
    (0.0, 0.11, 0.0, 0.19, 0.13, 0.0, 0.16, 0.0, 0.12, 0.0, 0.08, 0.21),
)
MIN_SAMPLES, MIN_SHARE = 5, 0.4
MIN_DRIFT_SAMPLES, MIN_DRIFT_SHARE, DRIFT_TOLERANCE = 10, 0.5, 1.5
OUTLIER_SECONDS, MIN_ANCHORS, MAX_GAP = 4.0, 6, 45.0
RESCUE_SHARE = 0.3


def calibrate(candidates: DataFrame, key: list[str], order: list[str], t: str, delta: str, model: str = "isotonic", rescued: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, anchors): kind constant, drift, isotonic or piecewise, or null, with offset, slope and confidence; anchors(key, x, y) of the accepted songs.

    A later tier is tried only where the ones before it do not agree well enough; the last one also needs some support from them, or that the song is
    among the rescued(key), those whose repeated lines are known to match the timed lyric's (alignment.repeat_structure).
    """
    candidates = checkpoint(candidates)
    # a row a song, read by every tier: without a checkpoint one task would hold the sorts and counts of them all at once
    one = checkpoint(E.constant_calibration(candidates, key, order, delta, MIN_SAMPLES, MIN_SHARE).withColumnRenamed("confidence", "share1"))
    open_ = candidates.join(one.where(~F.col("accepted") & (F.col("total") >= MIN_DRIFT_SAMPLES)).select(*key), key, "left_semi")
    two = checkpoint(E.theil_sen(open_, key, t, delta, DRIFT_TOLERANCE).withColumnRenamed("share", "share2"))
    weak = two.where(F.col("share2") < MIN_DRIFT_SHARE).join(one.select(*key, "share1"), key)
    supported = F.greatest("share1", "share2") >= RESCUE_SHARE
    if rescued is not None:
        weak = weak.join(rescued.select(*key).distinct().withColumn("_rescued", F.lit(True)), key, "left")
        supported = supported | F.coalesce("_rescued", F.lit(False))
    weak = weak.where(supported).drop("_rescued")
    near = open_.join(weak, key).where(F.abs(F.col(delta) - (F.col("intercept") + F.col("slope") * F.col(t))) <= OUTLIER_SECONDS)
    near = near.withColumns({"x": F.col(t).cast("double"), "y": (F.col(t) + F.col(delta)).cast("double")})
    near = checkpoint(near)
    fitted = N.isotonic_anchors(near, key, "x", "y") if model == "isotonic" else O.monotone_anchors(near, key, ["x", *order], "y").select(*key, "x", "y")
    fitted = checkpoint(fitted)
    size = fitted.groupBy(*key).agg(F.count("*").alias("n")).join(E.max_anchor_gap(fitted, key), key).where((F.col("n") >= MIN_ANCHORS) & (F.col("max_gap") <= MAX_GAP))
    share3 = near.groupBy(*key).agg(F.count("*").alias("kept")).join(one.select(*key, "total"), key).select(*key, (F.col("kept") / F.col("total")).alias("share3"))
    three = checkpoint(size.select(*key).join(share3, key))
    summary = one.join(two, key, "left").join(three, key, "left")
    drift = F.col("share2") >= MIN_DRIFT_SHARE
    kind = F.when(F.col("accepted"), "constant").when(drift, "drift").when(F.col("share3").isNotNull(), model)
    offset = F.when(kind == "constant", F.col("offset")).when(kind == "drift", F.col("intercept"))
    slope = F.when(kind == "constant", 0.0).when(kind == "drift", F.col("slope"))
    confidence = F.when(kind == "constant", F.col("share1")).when(kind == "drift", F.col("share2")).when(kind.isNotNull(), F.col("share3")).otherwise(0.0)
    summary = summary.select(*key, kind.alias("kind"), offset.alias("offset"), slope.alias("slope"), confidence.alias("confidence"), "total")
    lines = summary.where(F.col("kind").isin("constant", "drift"))
    line = lambda x: F.struct(F.lit(x).alias("x"), (F.lit(x) + F.col("offset") + F.col("slope") * x).alias("y"))
    simple = lines.select(*key, F.explode(F.array(line(0.0), line(1000.0))).alias("p")).select(*key, "p.x", "p.y")
    return summary, simple.unionByName(fitted.join(three.select(*key), key, "left_semi").select(*key, "x", "y"))


def class_offset(matches: DataFrame, key: list[str], order: list[str], ours: str, theirs: str, confidence: str, min_samples: int = 8, least: float = 0.5, top_half: float = 0.4, force: bool = True) -> DataFrame:
    """key, offset, share: the most frequent class difference of matched notes, over all, else over the more confident half.

    The half has min_samples notes at least. Where neither agrees well enough, the better of the two is taken with force (all notes on ties), else none.
    """
    bucket = F.pmod(F.col(theirs) - (F.col(ours) + 60), F.lit(12)).cast("long")
    every = E.mode_share(matches, key, order, bucket)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(confidence), *order))
    half = matches.withColumns({"_rank": rank, "_n": F.count("*").over(Window.partitionBy(*key))}).where(F.col("_rank") <= F.greatest(F.lit(min_samples), F.floor(F.col("_n") / 2)))
    upper = E.mode_share(half, key, ["_rank"], bucket).select(*key, F.col("bucket").alias("b2"), F.col("share").alias("s2"))
    all_, second = F.col("share") >= least, (F.col("s2") >= top_half) | (F.lit(force) & (F.col("s2") > F.col("share")))
    pick = lambda a, b: F.when(F.col("total") < min_samples, None).when(all_, F.col(a)).when(second, F.col(b)).when(F.lit(force), F.col(a))
    return every.join(upper, key, "left").select(*key, pick("bucket", "b2").alias("offset"), F.coalesce(pick("share", "s2"), F.lit(0.0)).alias("share"))


def likely_key(classes: DataFrame, key: list[str], pc: str) -> DataFrame:
    """key, song_key: the key whose table row weighs a song's classes most, the lowest on ties."""
    counts = classes.groupBy(*key, F.col(pc).alias("pc")).agg(F.count("*").alias("n"))
    rows = F.array(*[F.array(*map(F.lit, row)) for row in KEY_TABLE])
    weighed = counts.select(*key, "n", "pc", F.posexplode(rows).alias("song_key", "row")).withColumn("w", F.get("row", F.col("pc").cast("int")) * F.col("n"))
    sums = weighed.groupBy(*key, "song_key").agg(F.bround(F.sum("w"), 9).alias("w"))
    return sums.groupBy(*key).agg(F.max_by("song_key", F.struct("w", -F.col("song_key"))).alias("song_key"))


def nudge(classes: DataFrame, keys: DataFrame, key: list[str], pc: str) -> DataFrame:
    """Adds nudged: a class that the song's key does not hold moves a step, up where that is at least as likely as down."""
    rows = F.array(*[F.array(*map(F.lit, row)) for row in KEY_TABLE])
    at = lambda step: F.get(F.get(rows, F.col("song_key")), F.pmod(F.col(pc) + step, F.lit(12)).cast("int"))
    moved = F.when(at(0) > 0, F.col(pc)).when(at(1) >= at(-1), F.pmod(F.col(pc) + 1, F.lit(12))).otherwise(F.pmod(F.col(pc) - 1, F.lit(12)))
    return classes.join(keys, key).withColumn("nudged", moved).drop("song_key")
