"""Robust estimators over candidates of a sequence: votes, fits, calibration, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline.functions import scalars as S
from chronoline.operators.ordered import over
from chronoline.operators.ranges import within_windows
from chronoline.operators.slopes import median_slopes

#: The Krumhansl-Kessler key profiles, from C.
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def weighted_mode(df: DataFrame, key: list[str], order: list[str], value: Column, weight: Column, name: str = "mode") -> DataFrame:
    """The half-even rounded value of most weight; weights of sum 0 count as 1; the first seen on ties."""
    voted = df.withColumns({"_v": F.bround(value).cast("long"), "_w": weight})
    total = F.sum("_w").over(Window.partitionBy(*key))
    voted = voted.withColumn("_w", F.when(total <= 0, 1.0).otherwise(F.col("_w")))
    votes = voted.groupBy(*key, "_v").agg(F.bround(F.sum("_w"), 9).alias("_w"), F.min(F.struct(*order)).alias("_seen"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_w"), "_seen"))
    return votes.withColumn("_r", rank).where("_r = 1").select(*key, F.col("_v").alias(name))


def mode_share(df: DataFrame, key: list[str], order: list[str], bucket: Column) -> DataFrame:
    """bucket, agree, total, share of the most frequent bucket, the first seen on ties."""
    votes = df.withColumn("_b", bucket).groupBy(*key, "_b").agg(F.count("*").alias("agree"), F.min(F.struct(*order)).alias("_seen"))
    votes = votes.withColumn("total", F.sum("agree").over(Window.partitionBy(*key)))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("agree"), "_seen"))
    return votes.withColumn("_r", rank).where("_r = 1").select(*key, F.col("_b").alias("bucket"), "agree", "total", (F.col("agree") / F.col("total")).alias("share"))


def constant_calibration(candidates: DataFrame, key: list[str], order: list[str], delta: str, min_samples: int = 5, min_share: float = 0.4) -> DataFrame:
    """First tier: the most frequent whole-second offset, accepted with enough candidates and agreement."""
    best = mode_share(candidates, key, order, F.bround(delta).cast("long"))
    ok = (F.col("total") >= min_samples) & (F.col("share") >= min_share)
    return best.select(*key, F.when(ok, F.col("bucket").cast("double")).alias("offset"), F.col("share").alias("confidence"), "total", ok.alias("accepted"))


def theil_sen(candidates: DataFrame, key: list[str], t: str, delta: str, tolerance: float = 1.5) -> DataFrame:
    """intercept, slope, inlier share: the medians of pairwise slopes and of intercepts.

    slopes.py finds the median slope without a row a pair.
    """
    slopes = median_slopes(candidates, key, t, delta)
    both = candidates.join(slopes, key)
    fit = both.groupBy(*key).agg(F.median(F.col(delta) - F.col("slope") * F.col(t)).alias("intercept"), F.first("slope").alias("slope"))
    residual = F.abs(F.col(delta) - (F.col("intercept") + F.col("slope") * F.col(t)))
    near = candidates.join(fit, key).groupBy(*key).agg(F.first("intercept").alias("intercept"), F.first("slope").alias("slope"), F.avg((residual <= tolerance).cast("double")).alias("share"))
    return near


def interpolate(points: DataFrame, anchors: DataFrame, key: list[str], t: str, row_id: str, x: str = "x", y: str = "y") -> DataFrame:
    """Adds fitted: piecewise linear through the anchors, their outer slopes beyond them; one anchor only shifts."""
    w = over(key, [x])
    n = F.count("*").over(Window.partitionBy(*key))
    segments = anchors.withColumns({"_k": F.row_number().over(w), "_n": n, "_x1": F.lead(x).over(w), "_y1": F.lead(y).over(w)})
    segments = segments.where((F.col("_k") < F.col("_n")) | (F.col("_n") == 1))
    seg = segments.select(
        *key, F.when(F.col("_k") == 1, float("-inf")).otherwise(F.col(x)).alias("_t"),
        F.struct(F.col(x).alias("x0"), F.col(y).alias("y0"), F.col("_x1").alias("x1"), F.col("_y1").alias("y1")).alias("_seg"),
    )
    marks = points.select(*key, F.col(t).cast("double").alias("_t"), row_id).withColumn("_seg", F.lit(None).cast(seg.schema["_seg"].dataType))
    line = seg.withColumn(row_id, F.lit(None).cast(points.schema[row_id].dataType)).withColumn("_o", F.lit(1)).unionByName(marks.withColumn("_o", F.lit(0)))
    # a point on an anchor belongs to the segment that ends there
    found = F.last("_seg", True).over(Window.partitionBy(*key).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = line.withColumn("_s", found).where(F.col(row_id).isNotNull())
    s, at = F.col("_s"), F.col("_t")
    fitted = F.when(s["x1"].isNull(), s["y0"] + (at - s["x0"])).when(s["x1"] == s["x0"], s["y0"]).otherwise(s["y0"] + (s["y1"] - s["y0"]) * (at - s["x0"]) / (s["x1"] - s["x0"]))
    return points.join(met.select(row_id, fitted.alias("fitted")), row_id)


def max_anchor_gap(anchors: DataFrame, key: list[str], x: str = "x") -> DataFrame:
    step = anchors.withColumn("_g", F.col(x) - F.lag(x).over(over(key, [x])))
    return step.groupBy(*key).agg(F.coalesce(F.max("_g"), F.lit(0.0)).alias("max_gap"))


def holdout_residual(anchors: DataFrame, key: list[str], row_id: str, x: str = "x", y: str = "y", min_anchors: int = 4) -> DataFrame:
    """Mean distance of every other anchor from the line through the rest; no row for a sequence with too few."""
    numbered = anchors.withColumns({"_k": F.row_number().over(over(key, [x])) - 1, "_n": F.count("*").over(Window.partitionBy(*key))}).where(F.col("_n") >= min_anchors)
    even, odd = numbered.where("_k % 2 = 0"), numbered.where("_k % 2 = 1")
    fitted = interpolate(even, odd.select(*key, x, y), key, x, row_id, x, y)
    return fitted.groupBy(*key).agg(F.avg(F.abs(F.col(y) - F.col("fitted"))).alias("residual"))


def class_mass(rows: DataFrame, key: list[str], values: str, bins: int = 12) -> DataFrame:
    """Sums of an array column by position modulo bins: key, pc, mass."""
    flat = rows.select(*key, F.posexplode(values).alias("i", "v"))
    return flat.groupBy(*key, F.pmod("i", F.lit(bins)).cast("int").alias("pc")).agg(F.sum(F.col("v").cast("double")).alias("mass"))


#: The cents over 10 Hz of the first bin of a pitch model's activation, and from bin to bin.
FIRST_CENTS, CENTS_STEP = 1997.3794084376191, 20.0
FRAME_BUCKET = 1.0


def note_class_mass(notes: DataFrame, frames: DataFrame, key: list[str], note: str, start: str, end: str, t: str, activation: str, first: float = FIRST_CENTS, step: float = CENTS_STEP) -> DataFrame:
    """key, note, pc, mass: the activation of a note's frames by pitch class, a bin's class being that of its cents.

    A note's frames start within it, both ends included; a note without one takes the next frame behind its start, and has no row if there is none.
    """
    own = notes.select(*key, note, F.col(start).alias("_s"), F.col(end).alias("_e"))
    shown = frames.select(*key, F.col(t).alias("_t"), F.col(activation).alias("_v"))
    inside = within_windows(shown, own, key, "_t", "_s", "_e", FRAME_BUCKET).select(*key, note, "_v")
    bare = own.join(inside.select(*key, note).distinct(), [*key, note], "left_anti")
    # notes and frames on one line of time: a note sees the first frame at or behind its start
    none = F.lit(None)
    line = bare.select(*key, note, F.col("_s").alias("_t"), none.cast(frames.schema[activation].dataType).alias("_v"), F.lit(0).alias("_side")).union(
        shown.select(*key, none.cast(notes.schema[note].dataType).alias(note), "_t", "_v", F.lit(1).alias("_side"))
    )
    behind = Window.partitionBy(*key).orderBy("_t", "_side").rowsBetween(1, Window.unboundedFollowing)
    next_ = line.withColumn("_next", F.first("_v", True).over(behind)).where("_side = 0 and _next is not null").select(*key, note, F.col("_next").alias("_v"))
    flat = inside.union(next_).select(*key, note, F.posexplode("_v").alias("_i", "_x"))
    pc = S.cents_to_class(F.lit(first) + F.col("_i") * F.lit(step))
    return flat.groupBy(*key, note, pc.alias("pc")).agg(F.sum(F.col("_x").cast("double")).alias("mass"))


def key_fit(mass: DataFrame, key: list[str]) -> DataFrame:
    """tonic, mode and corr of the best of 24 rotated profiles; a constant mass is C major. Major and low tonics come first on ties."""
    spark = mass.sparkSession
    rows = [(m, mode, tonic, (pc + tonic) % 12, p[pc]) for m, (mode, p) in enumerate((("major", MAJOR_PROFILE), ("minor", MINOR_PROFILE))) for tonic in range(12) for pc in range(12)]
    profiles = spark.createDataFrame(rows, "mode_rank int, mode string, tonic int, pc int, weight double")  # 288 rows
    joined = mass.join(F.broadcast(profiles), "pc")
    fits = joined.groupBy(*key, "mode_rank", "mode", "tonic").agg(
        F.try_divide(F.covar_pop("weight", "mass"), F.stddev_pop("weight") * F.stddev_pop("mass")).alias("corr")
    )
    fits = fits.withColumn("corr", F.bround(F.coalesce("corr", F.lit(0.0)), 9))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("corr"), "mode_rank", "tonic"))
    return fits.withColumn("_r", rank).where("_r = 1").select(*key, "tonic", "mode", "corr")


def top_two(mass: DataFrame, key: list[str]) -> DataFrame:
    """top1, top2 (classes, the higher class on ties) and margin = (m1 - m2) / m1, 1 where m1 is not positive."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("mass"), F.desc("pc")))
    r = mass.withColumn("_r", rank).where("_r <= 2")
    pick = lambda k, c: F.max(F.when(F.col("_r") == k, F.col(c)))
    out = r.groupBy(*key).agg(pick(1, "pc").alias("top1"), pick(2, "pc").alias("top2"), pick(1, "mass").alias("m1"), pick(2, "mass").alias("m2"))
    return out.withColumn("margin", F.when(F.col("m1") > 0, (F.col("m1") - F.col("m2")) / F.col("m1")).otherwise(1.0))


def energy_gate(frames: DataFrame, key: list[str], db: str, percentile: float = 0.9, below: float = 40.0, floor: float = -50.0) -> DataFrame:
    """Adds loud: not more than ``below`` under the track's percentile, and not under the floor."""
    reference = frames.groupBy(*key).agg(F.percentile(db, percentile).alias("_ref"))
    return frames.join(reference, key).withColumn("loud", (F.col(db) >= F.col("_ref") - below) & (F.col(db) >= floor)).drop("_ref")


def confidence_floor(frames: DataFrame, key: list[str], conf: str, percentile: float = 0.5) -> DataFrame:
    """Frames at the percentile of their note or above; all of them where fewer than max(3, n // 4) would be left or n < 4."""
    n, level = frames.groupBy(*key).agg(F.count("*").alias("_n"), F.percentile(conf, percentile).alias("_level")), F.col(conf) >= F.col("_level")
    joined = frames.join(n, key).withColumn("_keep", level)
    left = F.sum(F.col("_keep").cast("long")).over(Window.partitionBy(*key))
    all_ = (F.col("_n") < 4) | (F.col("_left") < F.greatest(F.lit(3), F.floor(F.col("_n") / 4)))
    return joined.withColumn("_left", left).where(F.col("_keep") | all_).drop("_n", "_level", "_keep", "_left")


def trim_attack(frames: DataFrame, key: list[str], order: list[str], k: int) -> DataFrame:
    """Without the first k frames of a note, unless fewer than max(3, k) would be left."""
    if k <= 0:
        return frames
    numbered = frames.withColumns({"_i": F.row_number().over(over(key, order)), "_n": F.count("*").over(Window.partitionBy(*key))})
    return numbered.where((F.col("_i") > k) | (F.col("_n") - k < max(3, k))).drop("_i", "_n")
