"""Queries of the range joins and the estimators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoline.operators import estimators as E
from chronoline.operators import ordered as O
from chronoline.operators import ranges as R
from chronoline.plans.sequence_queries import EV, KEY, ORDER, PRE, UPTO, WIN, events
from chronoline.session import dealt_by_rows, table

SECONDS = f"{EV}, t as (select *, (t_us - min(t_us) over (partition by user_id)) / 1e6 as s from ev)"


def seconds(spark, sf_dir):
    # in the order that what follows needs, so that rows are sorted once
    whole = O.over(KEY, ORDER).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rel = (F.col("t_us") - F.min("t_us").over(whole)) / 1e6
    return dealt_by_rows(events(spark, sf_dir), KEY).withColumn("s", rel)


def _spans_and_notes(spark, sf_dir):
    """Sign-ups are spans (words), the other events notes."""
    ev = seconds(spark, sf_dir)
    spans = ev.where("event_type = 'signup'").select("user_id", "t_us", "event_id", F.col("s").alias("a"), (F.col("s") + F.col("value") * 60).alias("b"))
    notes = ev.where("event_type <> 'signup'").select("user_id", "t_us", "event_id", F.col("s").alias("a"), (F.col("s") + F.col("value") * 200).alias("b"), F.floor("value").alias("pitch"))
    return spans, notes


SPANS = f"""{SECONDS}, sp as (select user_id, t_us, event_id, s as a, s + value * 60 as b from t where event_type = 'signup'),
nt as (select user_id, t_us, event_id, s as a, s + value * 200 as b, floor(value)::bigint as pitch from t where event_type <> 'signup'),
rw as (select *, lead(a) {WIN} as nx, row_number() {WIN} - 1 as zone from sp),
bd as (select user_id, zone, max(greatest((b + nx) / 2.0, a)) {UPTO} as boundary, nx from rw),
bo as (select user_id, zone, boundary from bd where nx is not null)"""


def zone_join(spark, sf_dir):
    spans, notes = _spans_and_notes(spark, sf_dir)
    bounds = R.zone_boundaries(spans, KEY, ORDER, "a", "b")
    return R.assign_zones(notes, bounds, KEY, ORDER, "a", "b", "event_id").select("user_id", "event_id", F.coalesce("zone", F.lit(0)).alias("zone"))


ZONE_SQL = f"""
with {SPANS}, m as (select *, max((a + b) / 2.0) {UPTO} as mid from nt)
select m.user_id, m.event_id, (select count(*) from bo where bo.user_id = m.user_id and bo.boundary <= m.mid) as zone from m"""


def interval_split(spark, sf_dir):
    spans, notes = _spans_and_notes(spark, sf_dir)
    bounds = R.zone_boundaries(spans, KEY, ORDER, "a", "b")
    out = R.split_by_boundaries(notes, bounds, KEY, "a", "b", "event_id")
    return out.select("user_id", "event_id", "zone", F.round("piece_start", 4).alias("piece_start"), F.round("piece_end", 4).alias("piece_end"), "first_piece")


SPLIT_SQL = f"""
with {SPANS}, w as (select *, (select count(*) from bo where bo.user_id = nt.user_id and bo.boundary <= nt.a) as lo,
   (select count(*) from bo where bo.user_id = nt.user_id and bo.boundary < nt.b) as hi0 from nt),
h as (select *, greatest(lo, hi0) as hi from w), p as (select *, unnest(range(lo, hi + 1)) as zone from h)
select p.user_id, p.event_id, p.zone, round(case when p.zone = lo then a else l.boundary end, 4) as piece_start,
       round(case when p.zone = hi then b else r.boundary end, 4) as piece_end, p.zone = lo as first_piece
from p left join bo l on l.user_id = p.user_id and l.zone = p.zone - 1 left join bo r on r.user_id = p.user_id and r.zone = p.zone"""


def nearest_asof(spark, sf_dir):
    spans, notes = _spans_and_notes(spark, sf_dir)
    numbered = notes.withColumn("pos", F.row_number().over(O.over(KEY, ORDER)))
    out = R.nearest_note(spans, numbered, KEY, "a", "b", "pos", ["pitch"], "event_id")
    return out.select("user_id", "event_id", F.col("near_pos").cast("long").alias("near_pos"), "near_pitch")


NEAREST_SQL = f"""
with {SPANS}, np as (select *, row_number() {WIN} as pos from nt),
d as (select sp.user_id, sp.event_id, np.pos, np.pitch, row_number() over (partition by sp.user_id, sp.event_id
   order by least(abs((sp.a + sp.b) / 2.0 - np.a), abs((sp.a + sp.b) / 2.0 - np.b)), np.pos) as r from sp join np on sp.user_id = np.user_id)
select user_id, event_id, pos as near_pos, pitch as near_pitch from d where r = 1"""


def range_mode(spark, sf_dir):
    """Weighted-mode pitch of the frames (all events) inside each span, after the confidence floor."""
    spans, _ = _spans_and_notes(spark, sf_dir)
    frames = seconds(spark, sf_dir).select("user_id", F.col("s").alias("ft"), F.col("event_id").alias("frame_id"), (F.col("value") / 40).alias("midi"), F.col("value").alias("conf"))
    inside = R.frames_in_notes(spans.select("user_id", F.col("event_id").alias("note_id"), "a", "b"), frames, KEY, "a", "b", "ft", "note_id", 36000.0)
    floored = E.confidence_floor(inside, ["user_id", "note_id"], "conf", 0.5)
    return E.weighted_mode(floored, ["user_id", "note_id"], ["ft", "frame_id"], F.col("midi"), F.col("conf"), "pitch")


RANGE_MODE_SQL = f"""
with {SPANS}, fr as (select user_id, s as ft, event_id as frame_id, value / 40 as midi, value as conf from t),
ins as (select sp.user_id, sp.event_id as note_id, ft, frame_id, midi, conf from sp join fr on sp.user_id = fr.user_id and ft between sp.a and sp.b),
st as (select user_id, note_id, count(*) as n, quantile_cont(conf, 0.5) as lv from ins group by all),
fl as (select ins.*, n, conf >= lv as k, count(*) filter (where conf >= lv) over (partition by ins.user_id, ins.note_id) as lft from ins join st using (user_id, note_id)),
ke as (select * from fl where k or n < 4 or lft < greatest(3, n // 4)),
v as (select user_id, note_id, round_even(midi, 0)::bigint as pitch, round_even(sum(conf), 9) as w, min(struct_pack(ft, frame_id)) as seen from ke group by all),
r as (select *, row_number() over (partition by user_id, note_id order by w desc, seen) as k from v)
select user_id, note_id, pitch from r where k = 1"""


def line_windows(spark, sf_dir):
    out = R.line_windows(seconds(spark, sf_dir), KEY, ORDER, "s")
    return out.select("user_id", "event_id", F.round("s", 6).alias("t"), F.round("t_end", 6).alias("t_end"))


LINE_WINDOWS_SQL = f"with {SECONDS} select user_id, event_id, round(s, 6) as t, round(coalesce(lead(s) {WIN}, s + 5.0), 6) as t_end from t"


def _candidates(spark, sf_dir):
    """One candidate an event: its time in hours and a drifting, noisy offset."""
    ev = seconds(spark, sf_dir)
    noise = F.when(F.col("event_type") == "error", F.col("value") / 50).otherwise(F.col("value") / 1000)
    return ev.select("user_id", "t_us", "event_id", (F.col("s") / 3600).alias("x"), (F.lit(3.0) + F.col("s") / 360000 + noise).alias("delta"))


CAND = f"{SECONDS}, ca as (select user_id, t_us, event_id, s / 3600 as x, 3.0 + s / 360000 + case when event_type = 'error' then value / 50 else value / 1000 end as delta from t)"


def offset_mode_share(spark, sf_dir):
    out = E.constant_calibration(_candidates(spark, sf_dir), KEY, ORDER, "delta")
    return out.select("user_id", F.coalesce("offset", F.lit(-999.0)).alias("offset"), F.round("confidence", 9).alias("confidence"), "total", "accepted")


OFFSET_SQL = f"""
with {CAND}, v as (select user_id, round_even(delta, 0)::bigint as b, count(*) as agree, min(struct_pack(t_us, event_id)) as seen from ca group by user_id, b),
r as (select *, sum(agree) over (partition by user_id)::bigint as total, row_number() over (partition by user_id order by agree desc, seen) as k from v)
select user_id, case when total >= 5 and agree / total >= 0.4 then b::double else -999.0 end as "offset", round(agree / total, 9) as confidence, total,
       total >= 5 and agree / total >= 0.4 as accepted from r where k = 1"""


def theil_sen(spark, sf_dir):
    out = E.theil_sen(_candidates(spark, sf_dir), KEY, "x", "delta")
    return out.select("user_id", F.round("intercept", 6).alias("intercept"), F.round("slope", 6).alias("slope"), F.round("share", 6).alias("share"))


THEIL_SQL = f"""
with {CAND}, sl as (select p.user_id, median((q.delta - p.delta) / (q.x - p.x)) as slope from ca p join ca q on p.user_id = q.user_id and p.event_id < q.event_id
  where abs(q.x - p.x) >= 1e-6 group by p.user_id),
ic as (select ca.user_id, median(delta - slope * x) as intercept, any_value(slope) as slope from ca join sl using (user_id) group by ca.user_id)
select ca.user_id, round(any_value(intercept), 6) as intercept, round(any_value(slope), 6) as slope,
       round(avg(case when abs(delta - (intercept + slope * x)) <= 1.5 then 1.0 else 0.0 end), 6) as share from ca join ic using (user_id) group by ca.user_id"""


def _anchors(spark, sf_dir):
    c = _candidates(spark, sf_dir).withColumn("y", F.col("x") + F.col("delta"))
    return O.monotone_anchors(c, KEY, ORDER, "y").select("user_id", "event_id", "x", "y")


ANCH = f"{CAND}, yy as (select *, x + delta as y from ca), mm as (select *, max(y) {PRE} as top from yy), an as (select user_id, event_id, x, y from mm where top is null or y >= top)"


def anchor_correction(spark, sf_dir):
    out = E.interpolate(_candidates(spark, sf_dir), _anchors(spark, sf_dir).drop("event_id"), KEY, "x", "event_id")
    return out.select("user_id", "event_id", F.round("fitted", 5).alias("fitted"))


CORRECTION_SQL = f"""
with {ANCH}, k as (select *, row_number() over (partition by user_id order by x) as k, count(*) over (partition by user_id) as n,
   lead(x) over (partition by user_id order by x) as x1, lead(y) over (partition by user_id order by x) as y1 from an),
sg as (select *, case when k = 1 then '-infinity'::double else x end as f from k where k < n or n = 1),
m as (select ca.user_id, ca.event_id, ca.x as t, sg.x as x0, sg.y as y0, sg.x1, sg.y1, row_number() over (partition by ca.user_id, ca.event_id order by sg.f desc) as r
      from ca join sg on ca.user_id = sg.user_id and sg.f < ca.x)
select user_id, event_id, round(case when x1 is null then y0 + t - x0 when x1 = x0 then y0 else y0 + (y1 - y0) * (t - x0) / (x1 - x0) end, 5) as fitted from m where r = 1"""


def anchor_spacing(spark, sf_dir):
    a = _anchors(spark, sf_dir)
    gaps, held = E.max_anchor_gap(a, KEY), E.holdout_residual(a, KEY, "event_id")
    return gaps.join(held, KEY, "left").select("user_id", F.round("max_gap", 6).alias("max_gap"), F.round(F.coalesce("residual", F.lit(-1.0)), 5).alias("residual"))


SPACING_SQL = f"""
with {ANCH}, g as (select user_id, coalesce(max(x - px), 0.0) as max_gap from (select *, lag(x) over (partition by user_id order by x) as px from an) group by user_id),
nm as (select *, row_number() over (partition by user_id order by x) - 1 as k, count(*) over (partition by user_id) as n from an),
od as (select *, row_number() over (partition by user_id order by x) as j, count(*) over (partition by user_id) as m, lead(x) over (partition by user_id order by x) as x1,
   lead(y) over (partition by user_id order by x) as y1 from nm where k % 2 = 1 and n >= 4),
sg as (select *, case when j = 1 then '-infinity'::double else x end as f from od where j < m or m = 1),
ev_ as (select e.user_id, e.event_id, e.x as t, e.y as ty, sg.x as x0, sg.y as y0, sg.x1, sg.y1, row_number() over (partition by e.user_id, e.event_id order by sg.f desc) as r
   from nm e join sg on e.user_id = sg.user_id and sg.f < e.x where e.k % 2 = 0 and e.n >= 4),
hr as (select user_id, avg(abs(ty - case when x1 is null then y0 + t - x0 when x1 = x0 then y0 else y0 + (y1 - y0) * (t - x0) / (x1 - x0) end)) as residual from ev_ where r = 1 group by user_id)
select g.user_id, round(max_gap, 6) as max_gap, round(coalesce(residual, -1.0), 5) as residual from g left join hr using (user_id)"""


def _mass(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v)).alias("act"))
    return E.class_mass(e, ["vec_id"], "act")


MASS = """x as (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings),
ms as (select vec_id, (i % 12)::int as pc, sum(abs(v)::double) as mass from x group by all)"""


def key_profile_corr(spark, sf_dir):
    out = E.key_fit(_mass(spark, sf_dir), ["vec_id"])
    return out.select("vec_id", F.col("tonic").cast("long").alias("tonic"), "mode", F.round("corr", 6).alias("corr"))


_PROFILES = ", ".join(f"({m}, '{n}', {t}, {(pc + t) % 12}, {p[pc]})" for m, (n, p) in enumerate((("major", E.MAJOR_PROFILE), ("minor", E.MINOR_PROFILE))) for t in range(12) for pc in range(12))
KEY_SQL = f"""
with {MASS}, pr(mr, mode, tonic, pc, w) as (values {_PROFILES}),
f as (select vec_id, mr, mode, tonic, round_even(coalesce(corr(w, mass), 0), 9) as c from ms join pr using (pc) group by all),
r as (select *, row_number() over (partition by vec_id order by c desc, mr, tonic) as k from f)
select vec_id, tonic::bigint as tonic, mode, round(c, 6) as corr from r where k = 1"""


def top2_tiebreak(spark, sf_dir):
    """The profile of the fitted key decides between the two strongest classes where their margin is under 0.35."""
    mass = _mass(spark, sf_dir)
    two, key = E.top_two(mass, ["vec_id"]), E.key_fit(mass, ["vec_id"])
    weight = lambda pc: F.when(F.col("mode") == "major", F.get(F.array(*map(F.lit, E.MAJOR_PROFILE)), F.pmod(F.col(pc) - F.col("tonic"), F.lit(12)))).otherwise(
        F.get(F.array(*map(F.lit, E.MINOR_PROFILE)), F.pmod(F.col(pc) - F.col("tonic"), F.lit(12)))
    )
    chosen = F.when((F.col("margin") < 0.35) & (weight("top1") < weight("top2")), F.col("top2")).otherwise(F.col("top1"))
    return two.join(key, "vec_id").select("vec_id", F.col("top1").cast("long").alias("top1"), F.col("top2").cast("long").alias("top2"), F.round("margin", 6).alias("margin"), chosen.cast("long").alias("pc"))


TOP2_SQL = f"""
with {MASS}, pr(mr, mode, tonic, pc, w) as (values {_PROFILES}),
f as (select vec_id, mr, mode, tonic, round_even(coalesce(corr(w, mass), 0), 9) as c from ms join pr using (pc) group by all),
ky as (select * from (select *, row_number() over (partition by vec_id order by c desc, mr, tonic) as k from f) where k = 1),
rk as (select *, row_number() over (partition by vec_id order by mass desc, pc desc) as r from ms),
tw as (select vec_id, max(case when r = 1 then pc end) as t1, max(case when r = 2 then pc end) as t2, max(case when r = 1 then mass end) as m1, max(case when r = 2 then mass end) as m2 from rk group by vec_id)
select tw.vec_id, t1::bigint as top1, t2::bigint as top2, round(case when m1 > 0 then (m1 - m2) / m1 else 1.0 end, 6) as margin,
  (case when case when m1 > 0 then (m1 - m2) / m1 else 1.0 end < 0.35 and p1.w < p2.w then t2 else t1 end)::bigint as pc
from tw join ky using (vec_id) join pr p1 on p1.mode = ky.mode and p1.tonic = ky.tonic and p1.pc = t1 join pr p2 on p2.mode = ky.mode and p2.tonic = ky.tonic and p2.pc = t2"""


def energy_gate(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("db", F.lit(20.0) * F.log10(F.col("value") / 500 + 1e-10))
    return E.energy_gate(ev, KEY, "db").select("user_id", "event_id", "loud")


ENERGY_SQL = f"""
with {EV}, d as (select *, 20.0 * log10(value / 500 + 1e-10) as db from ev), r as (select user_id, quantile_cont(db, 0.9) as ref from d group by user_id)
select d.user_id, event_id, db >= ref - 40 and db >= -50 as loud from d join r using (user_id)"""


def attack_trim(spark, sf_dir):
    ev = O.gap_groups(events(spark, sf_dir), KEY, ORDER, "t_us", "t_us", 86_400_000_000)
    return E.trim_attack(ev, ["user_id", "grp"], ORDER, 2).select("user_id", "grp", "event_id")


ATTACK_SQL = f"""
with {EV}, f as (select *, case when t_us - lag(t_us) {WIN} > 86400000000 then 1 else 0 end as s from ev), g as (select *, sum(s) {UPTO} as grp from f),
n as (select *, row_number() over (partition by user_id, grp order by t_us, event_id) as i, count(*) over (partition by user_id, grp) as n from g)
select user_id, grp::bigint as grp, event_id from n where i > 2 or n - 2 < 3"""

QUERIES = {
    "zone_join": zone_join, "interval_split": interval_split, "nearest_asof": nearest_asof, "range_mode": range_mode, "line_windows": line_windows,
    "offset_mode_share": offset_mode_share, "theil_sen": theil_sen, "anchor_correction": anchor_correction, "anchor_spacing": anchor_spacing,
    "key_profile_corr": key_profile_corr, "top2_tiebreak": top2_tiebreak, "energy_gate": energy_gate, "attack_trim": attack_trim,
}
ORACLES = {
    "zone_join": ZONE_SQL, "interval_split": SPLIT_SQL, "nearest_asof": NEAREST_SQL, "range_mode": RANGE_MODE_SQL, "line_windows": LINE_WINDOWS_SQL,
    "offset_mode_share": OFFSET_SQL, "theil_sen": THEIL_SQL, "anchor_correction": CORRECTION_SQL, "anchor_spacing": SPACING_SQL,
    "key_profile_corr": KEY_SQL, "top2_tiebreak": TOP2_SQL, "energy_gate": ENERGY_SQL, "attack_trim": ATTACK_SQL,
}
