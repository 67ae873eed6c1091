"""Oracle SQL of queries whose order matters row by row: alignments, pools, open lines, tiers and syllables.

Longest common blocks, isotonic pools and open lines are walks, so they are recursive common table expressions.
"""

from __future__ import annotations

from chronoline.functions.syllables import KNOWN_ONSETS
from chronoline.operators.calibration import KEY_TABLE
from chronoline.plans.estimator_queries import CAND, SECONDS
from chronoline.plans.sequence_queries import UPTO, WIN

NORM = "regexp_replace(translate(lower({0}), '’‘', ''''''), '[^a-z0-9'']', '', 'g')"


def matched(name: str, left: str, right: str) -> str:
    """CTEs up to ``name``(k, i, j): places of equal tokens by longest common blocks, the first one on ties.

    left and right are tables (k, pos, w) whose places count from 0 without gaps. Equal tokens lie on diagonals; a step
    takes the longest stretch of a diagonal inside each open pair of spans and opens the spans before and behind it.
    """
    stretch = f"""{name}_d d on d.k = s.k and least(d.i1, s.ah, s.bh + d.d) > greatest(d.i0, s.al, s.bl + d.d)"""
    best = "min(struct_pack(n := greatest(d.i0, s.al, s.bl + d.d) - least(d.i1, s.ah, s.bh + d.d), i := greatest(d.i0, s.al, s.bl + d.d), j := greatest(d.i0, s.al, s.bl + d.d) - d.d))"
    return f"""{name}_p as (select l.k, l.pos as i, r.pos as j from {left} l join {right} r on l.k = r.k and l.w = r.w),
{name}_g as (select k, i, i - j as d, i - row_number() over (partition by k, i - j order by i) as g from {name}_p),
{name}_d as (select k, d, min(i) as i0, max(i) + 1 as i1 from {name}_g group by k, d, g),
{name}_s(k, al, ah, bl, bh) as (
  select l.k, 0::bigint, max(l.n), 0::bigint, max(r.n) from (select k, count(*) as n from {left} group by k) l join (select k, count(*) as n from {right} group by k) r on l.k = r.k group by l.k
  union all
  select k, case when side = 0 then al else b.i - b.n end, case when side = 0 then b.i else ah end, case when side = 0 then bl else b.j - b.n end, case when side = 0 then b.j else bh end
  from (select s.k, s.al, s.ah, s.bl, s.bh, {best} as b from {name}_s s join {stretch} group by s.k, s.al, s.ah, s.bl, s.bh) x, (values (0), (1)) v(side)
  where (side = 0 and al < b.i and bl < b.j) or (side = 1 and b.i - b.n < ah and b.j - b.n < bh)),
{name}_b as (select s.k, s.al, s.ah, s.bl, s.bh, {best} as b from {name}_s s join {stretch} group by s.k, s.al, s.ah, s.bl, s.bh),
{name} as (select k, b.i + o as i, b.j + o as j from (select k, b, unnest(range(-b.n)) as o from {name}_b))"""


VERIFY_SQL = f"""
with recursive {SECONDS}, lf as (select user_id as k, row_number() {WIN} - 1 as pos, event_type || (floor(value)::bigint % 7) as w, s, floor(value)::bigint as p from t),
rt as (select k, pos as old, row_number() over (partition by k order by pos) - 1 as pos, w, s + case when p % 4 = 0 then 0.7 else 0.1 end as s, case when p % 9 = 0 then p + 1 else p end as p from lf where p < 400),
{matched("mt", "lf", "rt")},
sm as (select mt.k, count(*) as matched, count(*) filter (where abs(l.s - r.s) <= 0.5) as in_time, count(*) filter (where abs(l.s - r.s) <= 0.5 and l.p % 12 = r.p % 12) as in_tune
  from mt join lf l on l.k = mt.k and l.pos = mt.i join rt r on r.k = mt.k and r.pos = mt.j group by mt.k),
n as (select k, count(*) as nl, (select count(*) from rt where rt.k = lf.k) as nr from lf group by k),
c as (select n.k, coalesce(matched, 0) as matched, coalesce(matched / nl, 0) as cl, coalesce(matched / nullif(nr, 0), 0) as cr, coalesce(in_time / nullif(matched, 0), 0) as tm,
  coalesce(in_tune / nullif(in_time, 0), 0) as pa, coalesce(in_time / nl, 0) as re, coalesce(in_time / nullif(nr, 0), 0) as pr from n left join sm using (k))
select k as user_id, matched, round(cl, 6) as coverage_left, round(cr, 6) as coverage_right, round(tm, 6) as timing, round(pa, 6) as pitch_accuracy,
  round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0.0 end, 6) as f1,
  case when matched < 10 then 'COULD_NOT_VERIFY' when least(pa, tm, cl, cr) >= 0.85 then 'PASS' else 'PROBLEMS_FOUND' end as verdict from c"""

#: Lines and tokens of the turns of conversations: ln(k, line_no, line), tk(k, pos, w, original, line_no).
TURNS = rf"""tl as (select conv_id * 100 + turn as k, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place, trim(unnest(string_split(coalesce(text, ''), chr(10))), chr(32) || chr(9) || chr(13)) as line from conversations),
ln as (select k, row_number() over (partition by k order by place) - 1 as line_no, line from tl where line <> '' and not regexp_matches(line, '^\[.*\]$') and not regexp_matches(lower(line), '^(paroles|lyrics powered by|www\.)')),
wd as (select k, line_no, generate_subscripts(regexp_split_to_array(trim(line), '[\s-]+'), 1) as place, unnest(regexp_split_to_array(trim(line), '[\s-]+')) as original from ln),
tk as (select k, row_number() over (partition by k order by line_no, place) - 1 as pos, {NORM.format("original")} as w, original, line_no from wd where {NORM.format("original")} <> '')"""

VOTED_SQL = f"""
with recursive {TURNS}, ot as (select k, row_number() over (partition by k order by pos) - 1 as pos, w, line_no + 10 as line_no from tk where pos % 5 <> 4),
{matched("mt", "tk", "ot")},
v as (select mt.k, l.line_no as ll, r.line_no as rl, count(*) as n, min(l.pos) as f from mt join tk l on l.k = mt.k and l.pos = mt.i join ot r on r.k = mt.k and r.pos = mt.j group by all),
b as (select *, row_number() over (partition by k, ll order by n desc, f) as r from v), z as (select k, line_no as ll, count(*) as words from tk group by all)
select k, ll as left_line, rl as right_line from b join z using (k, ll) where r = 1 and n >= greatest(1, (words + 1) // 2)"""

ALIGN_SQL = rf"""
with recursive {TURNS}, hw as (select conv_id * 100 + turn as k, generate_subscripts(regexp_split_to_array(trim(text, ' '), '\s+'), 1) - 1 as pos, unnest(regexp_split_to_array(trim(text, ' '), '\s+')) as text from conversations),
hd as (select k, pos::bigint as pos, text, {NORM.format("text")} as w, count(*) over (partition by k) as n from hw),
wt as (select k - 100 as k, pos, w, original, line_no from tk), wn as (select k, count(*) as m from wt group by k),
{matched("mt", "hd", "wt")},
ga as (select hd.k, hd.pos, hd.text, hd.w, hd.n, wn.m, mt.j, coalesce(1 + max(mt.i) over f, 0) as a0, coalesce(1 + max(mt.j) over f, 0) as b0, coalesce(min(mt.i) over t, hd.n) as a1, coalesce(min(mt.j) over t, wn.m) as b1
  from hd left join wn on wn.k = hd.k left join mt on mt.k = hd.k and mt.i = hd.pos
  window f as (partition by hd.k order by hd.pos rows between unbounded preceding and current row), t as (partition by hd.k order by hd.pos rows between current row and unbounded following)),
gb as (select *, coalesce(j, case when m is not null and b1 > b0 then least(b0 + pos - a0, b1 - 1) end) as place, a1 - a0 as na, b1 - b0 as nb from ga),
gc as (select gb.*, wt.w as ww, wt.original, wt.line_no as ln from gb left join wt on wt.k = gb.k and wt.pos = gb.place),
pa as (select distinct w as a, ww as b from gc where j is null and na = nb and ww is not null), pk as (select a || '|' || b as k, a, b from pa),
ca as (select k, generate_subscripts(string_split(a, ''), 1) - 1 as pos, unnest(string_split(a, '')) as w from pk where a <> ''),
cb as (select k, generate_subscripts(string_split(b, ''), 1) - 1 as pos, unnest(string_split(b, '')) as w from pk where b <> ''),
{matched("mc", "ca", "cb")},
al as (select a, b, 2.0 * coalesce((select count(*) from mc where mc.k = pk.k), 0) / greatest(1, length(a) + length(b)) >= 0.3 as alike from pk),
rs as (select gc.*, al.alike, nb > 0 and na <> nb and na - nb + 1 > 1 and place = b1 - 1 as crowded from gc left join al on al.a = gc.w and al.b = gc.ww),
ot as (select k, pos, case
    when j is not null or m is null or nb = 0 then text
    when na = nb then case when not alike then text when original <> text and regexp_matches(text, '^[A-Z]') and regexp_matches(original, '^[a-z]') then upper(original[1]) || original[2:] else original end
    else text end as new_text,
  case when m is null then '' when j is not null then original when nb = 0 then '' when na = nb then case when alike then original else '' end
    when crowded and (n = 1 or na - nb + 1 > 8) then '' else original end as reference_text,
  case when m is null or (j is null and nb = 0) or (j is null and crowded and n = 1) then null else ln end as ln,
  m is not null and j is null and ((nb = 0 and na <= 5) or coalesce(crowded and n = 1, false)) as dropped from rs)
select k, pos, new_text, reference_text, coalesce(last_value(ln ignore nulls) over (partition by k order by pos rows between unbounded preceding and current row), -1) as line_no, dropped from ot"""

REPEAT_SQL = rf"""
with l as (select doc_id, source, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place, trim(unnest(string_split(coalesce(text, ''), chr(10))), chr(32) || chr(9) || chr(13)) as line from documents),
f as (select source, doc_id * 1000000 + row_number() over (partition by doc_id order by place) - 1 as line_no, line from l where line <> '' and not regexp_matches(line, '^\[.*\]$') and not regexp_matches(lower(line), '^(paroles|lyrics powered by|www\.)')),
n as (select source, line_no, list_filter(list_transform(regexp_split_to_array(line, '\s+'), lambda x: {NORM.format("x")}), lambda x: x <> '') as ws from f),
w as (select source, line_no, unnest(ws) as w from n), wo as (select source, w, count(*) as our from w group by all), wh as (select source, w, count(*) as their from w where line_no % 2 = 0 group by all),
g as (select source, array_to_string(ws, ' ') as line, count(*) as c, min(line_no) as first from n where len(ws) > 0 group by all),
p as (select source, line from (select *, row_number() over (partition by source order by c desc, first) as r from g) where r = 1 and c >= 3),
q as (select distinct source, line, unnest(string_split(line, ' ')) as w from p),
b as (select *, row_number() over (partition by source order by our desc, w) as r from q join wo using (source, w) where length(w) >= 4)
select source, line, w as word, our as our_count, coalesce(their, 0) as their_count, abs(our - coalesce(their, 0)) > greatest(1.0, round_even(our * 0.15, 0)) as differs
from b left join wh using (source, w) where r = 1 and our >= 3"""


def pools(name: str, rows: str) -> str:
    """CTEs up to ``name``(user_id, x, y): isotonic pools of rows(user_id, x, y), as the steps of the lower hull of the running sums."""
    upto = "over (partition by user_id order by x rows between unbounded preceding and current row)"
    return f"""{name}_c as (select user_id, row_number() {upto} as v, sum(x) {upto} as sx, sum(y) {upto} as sy from {rows} union all select distinct user_id, 0, 0.0, 0.0 from {rows}),
{name}_n as (select a.user_id, a.v, min(struct_pack(m := (b.sy - a.sy) / (b.v - a.v), w := b.v, x := (b.sx - a.sx) / (b.v - a.v))) as b from {name}_c a join {name}_c b on a.user_id = b.user_id and b.v > a.v group by a.user_id, a.v),
{name}_w(user_id, v, b) as (select user_id, v, b from {name}_n where v = 0 union all select n.user_id, n.v, n.b from {name}_w w join {name}_n n on n.user_id = w.user_id and n.v = w.b.w),
{name} as (select user_id, b.x as x, b.m as y from {name}_w)"""


PAVA_SQL = f"with recursive {CAND}, rw as (select user_id, x, x + delta as y from ca), {pools('po', 'rw')} select user_id, round(x, 6) as x, round(y, 6) as y from po"

TIERS_SQL = f"""
with recursive {CAND}, v as (select user_id, round_even(delta, 0)::bigint as b, count(*) as agree, min(struct_pack(t_us, event_id)) as seen from ca group by user_id, b),
o as (select user_id, agree / sum(agree) over (partition by user_id) as share1, sum(agree) over (partition by user_id) as total, row_number() over (partition by user_id order by agree desc, seen) as k from v),
o1 as (select user_id, share1, total, total >= 5 and share1 >= 0.4 as accepted from o where k = 1),
op as (select ca.* from ca join o1 using (user_id) where not accepted and total >= 10),
sl as (select p.user_id, median((q.delta - p.delta) / (q.x - p.x)) as slope from op p join op q on p.user_id = q.user_id and p.event_id < q.event_id where abs(q.x - p.x) >= 1e-6 group by p.user_id),
ic as (select user_id, median(delta - slope * x) as intercept, any_value(slope) as slope from op join sl using (user_id) group by user_id),
t2 as (select user_id, any_value(intercept) as intercept, any_value(slope) as slope, avg(case when abs(delta - (intercept + slope * x)) <= 1.5 then 1.0 else 0.0 end) as share2 from op join ic using (user_id) group by user_id),
nr as (select op.user_id, op.x, op.x + op.delta as y from op join t2 using (user_id) join o1 using (user_id) where share2 < 0.5 and greatest(share1, share2) >= 0.3 and abs(delta - (intercept + slope * op.x)) <= 4.0),
{pools("po", "nr")},
st as (select user_id, x, x - lag(x) over (partition by user_id order by x) as g from po), sz as (select user_id, count(*) as n, coalesce(max(g), 0.0) as gap from st group by user_id),
t3 as (select sz.user_id, sz.n, (select count(*) from nr where nr.user_id = sz.user_id) / total as share3 from sz join o1 using (user_id) where n >= 6 and gap <= 45.0),
a as (select o1.*, share2, share3, n, case when accepted then 'constant' when share2 >= 0.5 then 'drift' when share3 is not null then 'isotonic' else '' end as kind from o1 left join t2 using (user_id) left join t3 using (user_id))
select user_id, kind, round(case kind when 'constant' then share1 when 'drift' then share2 when 'isotonic' then share3 else 0.0 end, 6) as confidence,
  case when kind in ('constant', 'drift') then 2 when kind = 'isotonic' then n else 0 end::bigint as anchors from a"""

FREE_SQL = f"""
with recursive {SECONDS}, y as (select user_id, t_us, event_id, s / 3600 as a, s / 3600 + value / 2000 as b, case when value < 480 then floor(s / 1728000)::bigint end as line, event_type in ('signup', 'view') as ws,
  event_type || case when value > 300 then ',' else '' end as text from t),
c as (select *, case when line is not distinct from lag(line) {WIN} and row_number() {WIN} > 1 then 0 else 1 end as o from y), r as (select *, sum(o) {UPTO} as run from c),
n as (select *, row_number() over (partition by user_id, run order by t_us, event_id) - 1 as i, count(*) over (partition by user_id, run) as n, sum(ws::int) over (partition by user_id, run order by t_us, event_id) as w,
  sum(ws::int) over (partition by user_id, run) as wn, lag(text) over (partition by user_id, run order by t_us, event_id) as pt from r where line is not null),
x as (select event_id from (select *, row_number() over (partition by user_id, run order by abs(i - n / 2), i) as rk from n where n >= 12 and ws and w > 1 and w < wn and wn >= 3 and (ends_with(pt, ',') or ends_with(pt, '.'))) where rk = 1),
z as (select user_id, event_id, row_number() {WIN} as k, ws, a - lag(b) {WIN} as gap, line, last_value(case when ws then line end ignore nulls) over (partition by user_id order by t_us, event_id rows between unbounded preceding and 1 preceding) as open_line,
  event_id in (select event_id from x) as forced from y),
q(user_id, event_id, k, cut, len) as (
  select user_id, event_id, k, false, 1 from z where k = 1
  union all
  select user_id, event_id, k, cut, case when cut then 1 else len + 1 end from (select z.user_id, z.event_id, z.k, q.len, case when not z.ws then false when z.line = z.open_line then z.forced
    else coalesce(z.line <> z.open_line, false) or gap >= 0.35 or ((z.line is null or z.open_line is null) and (q.len >= 12 or (q.len >= 8 and gap >= 0.15))) end as cut from q join z on z.user_id = q.user_id and z.k = q.k + 1))
select user_id, event_id from q where cut"""

_TABLE = ", ".join(f"({k}, {pc}, {v})" for k, row in enumerate(KEY_TABLE) for pc, v in enumerate(row))
REFRESH_SQL = f"""
with {SECONDS}, e as (select user_id, row_number() {WIN} - 1 as pos, event_type, value, s / 3600 as h from t),
nt as (select user_id, pos, h as a, h + 20 as b, floor(value / 40)::bigint as pitch from e where event_type = 'purchase'),
ins as (select nt.user_id, nt.pos, e.h as ft, 50 + value / 20 as midi, value / 500 as conf from nt join e on e.user_id = nt.user_id and e.h between nt.a and nt.b where event_type <> 'error'),
st as (select user_id, pos, count(*) as n, quantile_cont(conf, 0.5) as lv from ins group by all),
fl as (select ins.*, n, conf >= lv as keep, count(*) filter (where conf >= lv) over (partition by ins.user_id, ins.pos) as lft from ins join st using (user_id, pos)),
ke as (select * from fl where keep or n < 4 or lft < greatest(3, n // 4)),
v as (select user_id, pos, round_even(midi, 0)::bigint as mode, round_even(sum(conf), 9) as w, min(ft) as seen from ke group by all),
m as (select user_id, pos, mode % 12 as pc from (select *, row_number() over (partition by user_id, pos order by w desc, seen) as r from v) where r = 1),
c as (select nt.user_id, nt.pos, pitch, last_value(pc ignore nulls) over (partition by nt.user_id order by nt.pos rows between unbounded preceding and current row) as pc from nt left join m on m.user_id = nt.user_id and m.pos = nt.pos),
kt(k, pc, p) as (values {_TABLE}), cn as (select user_id, pc, count(*) as n from c where pc is not null group by all),
kw as (select user_id, k, round_even(sum(p * n)::double, 9) as w from cn join kt using (pc) group by all), kb as (select user_id, k from (select *, row_number() over (partition by user_id order by w desc, k) as r from kw) where r = 1)
select c.user_id as song_id, c.pos, c.pitch, case when c.pc is null then c.pitch else floor(c.pitch / 12)::bigint * 12 + case when p0.p > 0 then c.pc when pu.p >= pd.p then (c.pc + 1) % 12 else (c.pc + 11) % 12 end end::bigint as new_pitch
from c left join kb on kb.user_id = c.user_id left join kt p0 on p0.k = kb.k and p0.pc = c.pc left join kt pu on pu.k = kb.k and pu.pc = (c.pc + 1) % 12 left join kt pd on pd.k = kb.k and pd.pc = (c.pc + 11) % 12"""

_ONSETS = ", ".join(f"'{o}'" for o in sorted(KNOWN_ONSETS))
SYLLABLES_SQL = rf"""
with w as (select distinct unnest(string_split(p_name, ' ')) as word from part),
e as (select word, regexp_extract(word, '^(\W*)(.*?)(\W*)$', 1) as lead, regexp_extract(word, '^(\W*)(.*?)(\W*)$', 2) as core, regexp_extract(word, '^(\W*)(.*?)(\W*)$', 3) as trail from w),
c as (select word, core, generate_subscripts(regexp_extract_all(core, '(?i)[aeiouy]+|[^aeiouy]+'), 1) as i, unnest(regexp_extract_all(core, '(?i)[aeiouy]+|[^aeiouy]+')) as chunk from e where core <> ''),
o as (select *, lower(chunk) as low, regexp_matches(chunk, '(?i)^[aeiouy]') as vowel, sum(length(chunk)) over (partition by word order by i) - length(chunk) as place, max(i) over (partition by word) as last from c),
s as (select *, sum(vowel::int) over (partition by word) as runs, regexp_matches(core, '(?i)[^aeiouy]e$') and not regexp_matches(core, '(?i)[^aeiouy]le$') as mute from o),
n as (select *, vowel and not (mute and runs > 1 and i = last) as nucleus from s), z as (select *, min(case when nucleus then i end) over (partition by word) as n0, max(case when nucleus then i end) over (partition by word) as n1 from n),
k as (select word, place + case when length(low) > 1 and low[1] = low[2] then 1 when length(low) >= 3 and right(low, 3) in ({_ONSETS}) then length(low) - 3 when length(low) >= 2 and right(low, 2) in ({_ONSETS}) then length(low) - 2 else length(low) - 1 end as cut
  from z where not vowel and i > n0 and i < n1),
f as (select word, list(cut order by cut) as cuts from k group by word),
p as (select e.*, case when core = '' then [word] else list_transform(range(0, len(coalesce(cuts, [])) + 1), lambda q: core[(case when q = 0 then 0 else cuts[q] end + 1)::bigint : (case when q = len(coalesce(cuts, [])) then length(core) else cuts[q + 1] end)::bigint]) end as sonorous,
  regexp_extract_all(core, '(?i)[^aeiouy]*[aeiouy]+(?:[^aeiouy]*$)?') as grp from e left join f using (word)),
b as (select word, lead, trail, core, case when len(list_filter(sonorous, lambda q: q <> '')) > greatest(1, len(grp)) then list_filter(sonorous, lambda q: q <> '') when len(grp) = 0 then [core] else grp end as parts from p)
select word, case when core = '' then word else lead || array_to_string(parts, '|') || trail end as parts from b"""

ORACLES = {
    "verify_metrics": VERIFY_SQL, "voted_lines": VOTED_SQL, "align_replace": ALIGN_SQL, "repeat_fingerprint": REPEAT_SQL, "pava": PAVA_SQL,
    "calibration_tiers": TIERS_SQL, "free_lines": FREE_SQL, "refreshed_pitches": REFRESH_SQL, "word_syllables": SYLLABLES_SQL,
}
