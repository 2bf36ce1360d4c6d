"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from chronoweave.sources.adapters import DETECTIONS_SQL as D
from chronoweave.sources.adapters import INTERVALS_SQL as IV
from chronoweave.sources.adapters import ROUTES_SQL as R

#: Route rows where the detections' CTE already has the events.
ROUTE_ROWS = R[R.index("tr as (") :]

#: Every frame of each session with its number of tracks.
FRAMES = """n as (select session, frame, count(distinct track)::bigint as n from d group by 1, 2),
sp as (select session, unnest(range(min(frame), max(frame) + 1)) as frame from n group by session),
fr as (select sp.session, sp.frame, coalesce(n.n, 0)::bigint as n from sp left join n using (session, frame))"""

#: Windows by gap (10) and cap (60), each from its start by pointers to its end and to the next start.
WINDOWS = """g as (select distinct session as s, frame as f from d),
g1 as (select *, case when f - lag(f) over (partition by s order by f) <= 10 then 0 else 1 end as nw from g),
k as (select s, f, sum(nw) over (partition by s order by f) as k from g1),
mx as (select s, max(f) as m from k group by 1),
e as (select a.s, a.k, a.f as st, min(b.f) as en from k a left join k b on a.s = b.s and a.k = b.k and b.f >= a.f + 59 group by all),
p as (select e.s, e.k, e.st, e.en, min(c.f) as nx from e left join k c on e.s = c.s and e.k = c.k and c.f > e.en group by all),
ws as (select s, k, min(f) as st from k group by 1, 2 union all select p.s, p.k, p.nx from ws join p on ws.s = p.s and ws.k = p.k and ws.st = p.st where p.nx is not null),
la as (select s, k, max(f) as lf from k group by 1, 2),
win as (select ws.s as session, ws.st as first, coalesce(p.en, least(la.lf + 9, mx.m)) as last, coalesce(p.en, least(la.lf + 9, mx.m)) - ws.st + 1 as n_frames
  from ws join p using (s, k, st) join la using (s, k) join mx using (s))"""

EVENTS = """ev as (select session, frame, 'count_change' as event from (select *, lag(n, 1, 0) over (partition by session order by frame) as b from fr) where n <> b
  union all select session, first, 'new_track:' || track from sn
  union all select session, last, 'track_left:' || track from (select *, row_number() over (partition by session, last order by first, track) as nth from sn) where nth = 1)"""
SPANS = "sn as (select session, track, min(frame) as first, max(frame) as last from d group by 1, 2)"

#: A box and another's overlap.
IOU = """case when {u} > 0 then {i} / ({u}) else 0 end"""


def _iou(a: str, b: str) -> str:
    inter = f"(greatest(0.0::double, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0::double, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    size = lambda t: f"(({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1))"
    union = f"({size(a)} + {size(b)} - {inter})"
    return IOU.format(u=union, i=inter)


DIRECTION = """case when n < 2 then 'unknown' when coalesce(ax, '') || coalesce(ay, '') = '' then 'mostly_static' else concat_ws('+', ax, ay) end"""
_AXES = "case when x1_ - x0_ >= 0.05::double then 'right' when x1_ - x0_ <= -0.05::double then 'left' end as ax, case when y1_ - y0_ >= 0.05::double then 'down' when y1_ - y0_ <= -0.05::double then 'up' end as ay"

#: The 30 nearest others of each vector whose id is divisible by 100, scores as doubles.
KNN = """v as (select vec_id, label::bigint as subject, embedding::double[] as vec from embeddings),
pr as (select q.vec_id as query, q.subject as truth, s.vec_id as row, s.subject, list_dot_product(q.vec, s.vec) as score from v q, v s where q.vec_id % 100 = 0 and s.vec_id <> q.vec_id),
kn as (select * from (select *, row_number() over (partition by query order by score desc, row) as nth from pr) where nth <= 30)"""
CAND = """ca as (select query, subject, greatest(0.0::double, max(score)) as score, count(*) filter (score >= 0.25::double) as votes, count(*) as shots,
  case when max(score) > 0 then first(row order by score desc, row) end as best_row from kn group by 1, 2)"""

#: Frames of windows with their marks, and detections in windows.
WFRAMES = """sg as (select session, frame, max((k >= 90)::int) = 1 as marked from d group by 1, 2),
wf as (select fr.session, win.first as win_, fr.frame, coalesce(sg.marked, false) as has_event from fr join win on fr.session = win.session and fr.frame between win.first and win.last left join sg on sg.session = fr.session and sg.frame = fr.frame),
wd as (select d.session, win.first as win_, d.frame, d.track, d.quality from d join win on d.session = win.session and d.frame between win.first and win.last)"""

EVEN = """case when len({x}) <= {k} then {x} when {k} <= 0 then [] when {k} = 1 then [{x}[len({x}) // 2 + 1]]
  else list_transform(range(0, {k}), lambda i: {x}[round_even(i::double * (len({x}) - 1) / ({k} - 1), 0)::bigint + 1]) end"""

#: Components of tracks that share an id on a route, per session.
COMPONENTS = """ids as (select session, track, 'body' as route, body as id from ro where body is not null union all select session, track, 'face', face from ro where face is not null
  union all select session, track, 'gait', gait from ro where gait is not null),
hub as (select session, route, id, min(track) as u, count(*) as n from ids group by 1, 2, 3 having count(*) > 1),
ed as (select ids.session, ids.route, hub.u, ids.track as v from ids join hub using (session, route, id) where ids.track <> hub.u),
ad as (select session, u as a, v as b from ed union select session, v, u from ed),
rc as (select session, track as a, track as b from ro union select rc.session, rc.a, ad.b from rc join ad on rc.session = ad.session and rc.b = ad.a),
co as (select session, a as track, min(b) as component from rc group by 1, 2)"""
MERGED = """gr as (select session, component, count(*) as n_tracks, min(body) as own from co join ro using (session, track) group by 1, 2 having count(*) > 1),
tp as (select session, coalesce(max(body), 0) as top from ro group by 1),
cn as (select gr.session, component, n_tracks, coalesce(own, top + row_number() over (partition by gr.session, own is null order by component)) as canonical from gr join tp using (session)),
rt as (select ed.session, component, string_agg(distinct route, ',' order by route) as merge_routes, count(distinct route) as merge_agree from ed join co on co.session = ed.session and co.track = ed.u group by 1, 2),
me as (select ro.session, ro.track, ro.first, ro.q, ro.n, co.component, coalesce(cn.n_tracks, 1) as n_tracks, coalesce(cn.canonical, ro.body) as subject, coalesce(rt.merge_routes, '') as merge_routes,
  coalesce(rt.merge_agree, 0) as merge_agree, cn.canonical is not null and ro.body is distinct from cn.canonical as cross_merged
  from ro join co using (session, track) left join cn on cn.session = ro.session and cn.component = co.component left join rt on rt.session = ro.session and rt.component = co.component)"""
RESOLVED = """rs as (select session, track, subject, first, q / 500.0::double as score, case when n % 4 = 0 then 'local' when cross_merged then 'merged' else 'hit' end as decision, n % 9 = 0 as split, merge_routes, cross_merged from me)"""

FACE = """f0 as (select event_id, (10 + k)::double as w, (12 + track)::double as h, k::double / 100.0::double * 0.6::double + 0.4::double as det, case when k % 7 <> 0 then quality end as blur,
  case when track % 5 <> 0 then (track % 10)::double / 10.0::double end as fiqa, 50.0::double + (k - 50) * 0.5::double as nx, 48.0::double + (track % 30 - 15) as ny from d),
f1 as (select *, least(w, h) as short, w * h as area, greatest(0.0::double, 1 - abs(nx - 50) / 40) as frontal, greatest(-90.0::double, least(90.0::double, (nx - 50) / 20 * 90)) as yaw,
  greatest(-90.0::double, least(90.0::double, ((ny - 35) / 37 - 0.5::double) * 200)) as pitch from f0),
f2 as (select *, abs(yaw) >= 80 as yb, pitch <= -35 or pitch >= 50 as pb, abs(yaw) <= 25 and abs(pitch) <= 20 as ac, det < 0.5::double as db, coalesce(blur < 15, false) as bb, coalesce(blur < 60, false) as dg, short < 28 as sb from f1),
f3 as (select *, case when yb or pb or bb or db or sb then 'poor' when ac and not dg and not db then 'clear' else 'marginal' end as category,
  concat_ws(',', case when sb then 'small_face' end, case when yb then 'extreme_yaw' when abs(yaw) > 25 then 'pose_yaw' end, case when pb then 'extreme_pitch' when abs(pitch) > 20 then 'pose_pitch' end,
    case when dg then 'blur' end, case when db then 'low_detection' end, case when fiqa < 0.6::double then 'low_fiqa' end, case when fiqa is null then 'fiqa_unavailable' end) as defects,
  case when sb then 'too_small' when yb then 'yaw_extreme' when pitch <= -35 then 'pitch_down' when pitch >= 50 then 'pitch_up' when bb or db then 'too_blurry' end as reason,
  det * (0.5::double + 0.5::double * frontal) * (0.5::double + 0.5::double * least(1.0::double, area / 10000)) * case when blur is null then 1.0::double else least(1.0::double, blur / 60) end as q0,
  case when yb or pb or db or short < 20 then 'unusable' when sb then 'recoverable' when (bb or dg) and short between 20 and 90 then 'recoverable' when bb then 'unusable' else 'direct' end as eligibility from f2)"""

FUSED = """x0 as (select *, track % 7 as subject, case when face is not null then n % 3 = 0 end as matched, case when face is not null then n % 5 <> 0 end as ready, n % 4 = 0 as clear,
  case when n % 7 <> 0 then (n % 11)::double / 10.0::double end as qs, case when n % 3 = 0 then (n % 13)::double / 13.0::double end as ms, (n % 6)::double / 6.0::double as fs0,
  case when gait is not null then (n % 9)::double / 8.0::double end as gs0, n % 3 in (0, 1) as firm from ro),
x1 as (select *, coalesce(ready, matched, false) as rd, greatest(0.0::double, least(1.0::double, coalesce(gs0, 0.0::double))) as gs, case when gs0 is not null then 0.2::double else 0.0::double end as gw,
  greatest(0.0::double, least(1.0::double, case when firm then greatest(q / 500.0::double, 0.5::double) else q / 500.0::double end)) as bs from x0),
x2 as (select *, case when rd then case when qs is not null then 0.5::double * (0.3::double + (1 - 0.3::double) * greatest(0.0::double, least(1.0::double, qs))) else 0.5::double * case when clear then 1.0::double else 0.35::double end end else 0.0::double end as fw,
  case when rd then greatest(0.0::double, least(1.0::double, case when coalesce(matched, false) then greatest(coalesce(ms, fs0), 0.6::double) else coalesce(ms, fs0) end)) else 0.0::double end as fs from x1),
x3 as (select *, (fs * fw + bs * 0.3::double + gs * gw) / (fw + 0.3::double + gw) as c0, fs > 0 and fw > 0 as fa, bs > 0 as ba, gs > 0 and gw > 0 as ga from x2),
x4 as (select *, (fa and coalesce(face % 7 = subject, false))::int + ba::int + (ga and coalesce(gait % 7 = subject, false))::int >= 2 as agreed, fa::int + ba::int + ga::int >= 2 as multi_source, greatest(fs * fw, bs * 0.3::double, gs * gw) as best from x3),
x5 as (select *, case when agreed then least(1.0::double, c0 + 0.15::double) else c0 end as c from x4)"""

def _hundredths(x: str) -> str:
    """Two places by the exact value of the double, in units of 2**-60."""
    w, u = f"(({x} * 1152921504606846976.0::double)::hugeint * 100)", "1152921504606846976::hugeint"
    return f"(({w} // {u} + case when {w} % {u} * 2 > {u} or {w} % {u} * 2 = {u} and {w} // {u} % 2 = 1 then 1 else 0 end)::double / 100)"


#: Small boxes matched one to one with large ones in a frame: pairs are walked from the best down, both ends once.
ASSOCIATED = """ap as (select a.session, a.frame, a.track as face, p.track, greatest(0.0::double, least(a.x1 + 12, p.x2) - greatest(a.x1, p.x1)) * greatest(0.0::double, least(a.y1 + 14, p.y2) - greatest(a.y1, p.y1)) / 168.0::double as score
  from d a join d p on a.session = p.session and a.frame = p.frame where a.x1 + 6 between p.x1 and p.x2 and (a.y1 + 7 - p.y1) / (p.y2 - p.y1) between -0.05::double and 0.48::double),
aq as (select *, row_number() over w as r, lead(score) over w as second from ap where score >= 0.6::double window w as (partition by session, frame, face order by score desc, track desc)),
ar as (select *, max(case when r = 1 then score - second end) over (partition by session, frame, face) as gap from aq),
at_ as (select session, frame, face, track, score, row_number() over (partition by session, frame order by score desc, face desc, track desc) as i from ar where gap is null or gap >= 0.08::double),
aw as (select session, frame, i, face, track, score, true as took, [face] as uf, [track] as ut from at_ where i = 1
  union all select x.session, x.frame, x.i, x.face, x.track, x.score, not (list_contains(w.uf, x.face) or list_contains(w.ut, x.track)),
    case when list_contains(w.uf, x.face) or list_contains(w.ut, x.track) then w.uf else list_append(w.uf, x.face) end, case when list_contains(w.uf, x.face) or list_contains(w.ut, x.track) then w.ut else list_append(w.ut, x.track) end
  from aw w join at_ x on x.session = w.session and x.frame = w.frame and x.i = w.i + 1),
asso as (select session, frame, face, track, round(score, 4) as score from aw where took)"""

#: Objects of windows as q10 tells them.
OBJECTS = f"""th as (select *, round((x1 + x2) / 2 / 120.0::double, 3) as cx, round((y1 + y2) / 2 / 140.0::double, 3) as cy from d where label <> 'person' and conf >= 0.35::double),
ov as (select session, track, max(conf) as conf, last(label order by frame) as label from th group by 1, 2),
ag as (select th.session, win.first as win_, track, count(distinct frame) as n, min(frame) as f0, max(frame) as f1, first(cx order by frame) as x0_, last(cx order by frame) as x1_, first(cy order by frame) as y0_, last(cy order by frame) as y1_
  from th join win on th.session = win.session and th.frame between win.first and win.last group by 1, 2, 3 having count(distinct frame) >= 2),
ax as (select *, {_AXES} from ag),
ob as (select session, win_, track, label, n, f0, f1, conf, {DIRECTION} as direction, row_number() over (partition by session, win_ order by n desc, f0, track) as nth from ax join ov using (session, track)),
ot as (select session, win_, string_agg('- ' || coalesce(map {{'backpack': '背包', 'car': '汽车', 'truck': '卡车', 'bus': '公交车'}}[label], label) || '(' || label || ') track#' || track || '：frame#' || f0 || '@' || C0_CLOCK || ' → frame#' || f1 || '@' || C1_CLOCK || '（共' || n || '帧）；' ||
  case when direction in ('mostly_static', 'unknown') then '基本静止' else '移动(' || direction || ')，疑似被搬动/取走/放下' end, chr(10) order by nth) filter (nth <= 20) as text, greatest(count(*) - 20, 0) as omitted from ob group by 1, 2)"""


def _clock(frame: str) -> str:
    s = f"round_even({frame} * 1.5::double, 0)::bigint"
    return f"format('{{:02d}}:{{:02d}}:{{:02d}}', {s} // 3600, {s} % 3600 // 60, {s} % 60)"


OBJECTS = OBJECTS.replace("C0_CLOCK", _clock("f0")).replace("C1_CLOCK", _clock("f1"))

GROUNDED = """gz as (select d.session, win_, d.frame, track, label, round(greatest(0.0::double, least(1.0::double, x1 / 120.0::double)), 4) as n1, round(greatest(0.0::double, least(1.0::double, y1 / 140.0::double)), 4) as n2,
  round(greatest(0.0::double, least(1.0::double, x2 / 120.0::double)), 4) as n3, round(greatest(0.0::double, least(1.0::double, y2 / 140.0::double)), 4) as n4 from d join wf on wf.session = d.session and wf.frame = d.frame and wf.has_event),
gc as (select *, round(((n1 + n3) / 2)::varchar::decimal(20, 18), 4)::double as cx, round(((n2 + n4) / 2)::varchar::decimal(20, 18), 4)::double as cy from gz)"""

#: Persons of windows: tracks in each, with what is known of them, rolled up.
PERSONS = """bb as (select session, track, first(x1 order by frame) as bx1, first(y1 order by frame) as by1, first(x2 order by frame) as bx2, first(y2 order by frame) as by2 from d group by 1, 2),
pi as (select session, track, case when n % 5 <> 0 then track % 9 end as subject, case when n % 7 <> 0 then q / 500.0::double end as score, ['hit', 'grey', 'new'][n % 3 + 1] as decision, n % 2 = 0 as reused, track % 17 = 0 as local_, track % 19 = 0 as split_,
  case when n % 4 = 0 then 'body,face' when n % 4 = 1 then 'gait' end as mr, case when track % 4 = 0 then track end as face, case when track % 3 = 0 then track end as gait, case when n % 2 = 0 then n::double / 10.0::double end as fused from ro),
pt as (select d.session, win.first as win_, win.last as wl, d.frame, d.track, x1, y1, x2, y2, round((x1 + x2) / 2 / 120.0::double, 3) as cx, round((y1 + y2) / 2 / 140.0::double, 3) as cy from d join win on win.session = d.session and d.frame between win.first and win.last),
pk as (select pt.*, pi.* exclude (session, track), coalesce('subject:' || subject, 'track:' || pt.track) as person from pt join pi on pi.session = pt.session and pi.track = pt.track),
pp as (select session, win_, person, count(*) as points, list({{'x': cx, 'y': cy}} order by frame, track) as path from pk group by 1, 2, 3),
pq as (select session, win_, person, track, any_value(subject) as subject, any_value(score) as score, any_value(decision) as decision, any_value(reused) as reused, any_value(local_) as local_, any_value(split_) as split_, any_value(mr) as mr,
  any_value(face) as face, any_value(gait) as gait, any_value(fused) as fused, max(case when frame = wl then [x1, y1, x2, y2] end) as lb from pk group by 1, 2, 3, 4),
pr_ as (select pq.*, coalesce(lb, [bx1, by1, bx2, by2]) as box, row_number() over (partition by session, win_, person order by coalesce(score, 0) desc, track) as r from pq join bb using (session, track)),
pg as (select session, win_, person, count(*) as nt, string_agg(track::varchar, ',' order by track) as tracks, max(coalesce(score, 0.0::double)) as score, first(face order by track) filter (face is not null) as face, first(gait order by track) filter (gait is not null) as gait,
  max(fused) as fused, max(score) as raw, list(mr) as mrs, bool_or(local_) as lo, bool_or(split_) as sp, first(track) filter (r = 1) as track, first(subject) filter (r = 1) as subject, first(decision) filter (r = 1) as d1, first(reused) filter (r = 1) as r1, first(box) filter (r = 1) as box from pr_ group by 1, 2, 3),
pw as (select pg.session, pg.win_, pg.person, track, tracks, nt, lo as lo_, sp as sp_, subject, case when nt = 1 then d1 when lo then 'local_stitched' when sp then 'conflict_split' else 'hit' end as decision, case when nt = 1 then r1 else not (lo or sp) end as reused,
  case when nt = 1 then raw when score > 0 then round(score, 4) end as score, face, gait, fused, coalesce(array_to_string(list_filter(list_sort(list_distinct(string_split(array_to_string(mrs, ','), ','))), lambda z: z <> ''), ','), '') as merge_routes, box, points, path
  from pg join pp using (session, win_, person))""".replace("{{", "{").replace("}}", "}")

BAND = "case when {0} is null then '未知' when {0} >= 0.75::double then '高' when {0} >= 0.55::double then '中' when {0} > 0 then '低' else '无' end"

BOOTSTRAP = """with c as (select user_id as pid, avg(value) as value from events group by 1), p as (select *, row_number() over (order by pid) - 1 as place, count(*) over () as n from c),
r as (select draw, ('0x' || substr(md5('b7|' || draw || '|' || place), 1, 12))::bigint % n as place from p, (select unnest(range(200)) as draw)),
bm as (select draw, avg(value) as mean from r join p using (place) group by 1)"""

SCENE_CONTEXT = r"""with l as (select source as session, doc_id as frame, doc_id // 40 * 40 as win_, unnest(string_split(coalesce(text, ''), chr(10))) as text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as line from documents),
k as (select session, win_, frame, line, regexp_replace(text, '^WS|WS$', '', 'g') as text, lower(regexp_replace(text, 'WS', '', 'g')) as key from l), f as (select * from k where key <> ''),
o as (select session, win_, frame, key, arg_min(text, line) as text, min(line) as line from f group by 1, 2, 3, 4), n as (select session, win_, count(distinct frame) as nf from o group by 1, 2),
g as (select session, win_, key, count(*) as seen, arg_min(text, (frame, line)) as shown, min((frame, line)) as at_ from o group by 1, 2, 3), s as (select *, nf >= 2 and seen >= greatest(2, floor(nf * 0.6::double)) as static from g join n using (session, win_)),
fx as (select session, win_, count(*) as n_static, string_agg(shown, ' | ' order by at_) as fixed from s where static group by 1, 2),
ch as (select session, win_, frame, '- frame#' || frame || ' @ ' || case when frame % 4 <> 0 then CLOCK else 'None' end || '：' || string_agg(text, ' | ' order by line, text) as told from o join s using (session, win_, key) where not static group by 1, 2, 3),
cr as (select *, row_number() over (partition by session, win_ order by frame) as r from ch),
ct as (select session, win_, string_agg(told, chr(10) order by r) filter (r <= 24) as told, greatest(count(*) - 24, 0) as omitted from cr group by 1, 2)
select session, win_ as "window", '【画面文字（OCR，逐关键帧；场景级，不代表任何人的身份）】' || coalesce(chr(10) || '固定文字（贯穿多帧，如摄像头名/地点）：' || fixed, '') || coalesce(chr(10) || '逐帧文字（多为时间戳/动态信息，frame#与 grounding 一一对应）：' || chr(10) || told, '') ||
  case when omitted > 0 then chr(10) || '  ... 其余 ' || omitted || ' 帧文字省略' else '' end as text, nf as n_frames, coalesce(n_static, 0) as n_static, coalesce(omitted, 0) as omitted from n left join fx using (session, win_) left join ct using (session, win_)
""".replace("WS", r"[\s\x0B\x1C-\x1F\x85\p{Z}]+").replace("CLOCK", "format('{:02d}:{:02d}:{:02d}', frame // 3600, frame % 3600 // 60, frame % 60)")

#: Who is where in event frames, with identities as PERSONS has them.
STANDING = """ig as (select d.session, wf.win_, d.frame, d.track, case when ro.n % 5 <> 0 then d.track % 9 end as subject, ['hit', 'grey', 'new'][ro.n % 3 + 1] as decision, coalesce('subject#' || case when ro.n % 5 <> 0 then d.track % 9 end, 'track#' || d.track) as label, d.x1, d.y1, d.x2, d.y2,
  round(greatest(0.0::double, least(1.0::double, x1 / 120.0::double)), 4) as n1, round(greatest(0.0::double, least(1.0::double, y1 / 140.0::double)), 4) as n2, round(greatest(0.0::double, least(1.0::double, x2 / 120.0::double)), 4) as n3, round(greatest(0.0::double, least(1.0::double, y2 / 140.0::double)), 4) as n4,
  round((x1 + x2) / 2 / 120.0::double, 4) as mx, round((y1 + y2) / 2 / 140.0::double, 4) as my from d join wf on wf.session = d.session and wf.frame = d.frame and wf.has_event left join ro on ro.session = d.session and ro.track = d.track)"""

ORACLES = {
    "q01_frame_sampling": f"""with {D}, s as (select session, floor(frame * 600 / 7200.0)::bigint as slot, min(frame) as frame from o group by 1, 2)
        select session, slot, frame, round(slot * 7200.0::double, 3) as seconds from s""",
    "q02_adaptive_sampling": f"""with recursive {D}, s as (select session, frame, max(k)::double / 100.0::double as scene from o group by 1, 2),
        nx as (select session, frame, least(min(case when scene > 0.97::double then frame end) over (partition by session order by frame rows between 1 following and unbounded following),
          min(frame) over (partition by session order by frame range between 12 following and unbounded following)) as nxt from s),
        w as (select session, min(frame) as frame, 0::bigint as nth from s group by 1 union all select w.session, nx.nxt, w.nth + 1 from w join nx on w.session = nx.session and w.frame = nx.frame where nx.nxt is not null)
        select session, frame, nth from w""",
    "q03_label_counts_per_frame": f"with {D} select session, frame, ['person', 'car', 'truck', 'bus', 'backpack'][k % 5 + 1] as label, count(*) as n from o group by 1, 2, 3",
    "q04_track_lifespan": f"""with {D} select session, track, min(frame) as first, max(frame) as last, count(distinct frame) as n_frames, max(quality) as best_quality from o
        group by 1, 2 having count(distinct frame) >= 3""",
    "q05_track_best_evidence": f"""with {D}, b as (select *, quality * least(1.0::double, (x2 - x1) * (y2 - y1) / 20000.0::double) as bq from d),
        r as (select *, row_number() over (partition by session, track order by bq desc, frame) as r from b) select session, track, frame as best_frame, bq as body_quality, conf from r where r = 1""",
    "q06_frame_semantic_events": f"with {D}, {FRAMES}, {SPANS}, {EVENTS} select session, frame, event from ev",
    "q07_gap_windows": f"""with {D}, a as (select distinct session, frame from o), b as (select *, case when frame - lag(frame) over (partition by session order by frame) <= 10 then 0 else 1 end as st from a),
        c as (select *, sum(st) over (partition by session order by frame)::bigint as part from b) select session, part, min(frame) as first, max(frame) as last, count(*) as n_active from c group by 1, 2""",
    "q08_capped_windows": f"with recursive {D}, {WINDOWS} select * from win",
    "q09_window_summary": f"""with recursive {D}, {FRAMES}, {SPANS}, {EVENTS}, {WINDOWS},
        di as (select win.session, win.first, count(*) as nd, count(distinct track) as nt, max(quality) as bq from win join d on d.session = win.session and d.frame between win.first and win.last group by 1, 2),
        ei as (select win.session, win.first, string_agg(distinct split_part(event, ':', 1), ',' order by split_part(event, ':', 1)) as kinds, count(*) as ne from win join ev on ev.session = win.session and ev.frame between win.first and win.last group by 1, 2)
        select session, first, last, n_frames, coalesce(nd, 0) as n_detections, coalesce(nt, 0) as n_tracks, bq as best_quality, coalesce(kinds, '') as kinds, coalesce(ne, 0) as n_events from win left join di using (session, first) left join ei using (session, first)""",
    "q10_object_context": f"""with recursive {D}, {WINDOWS},
        th as (select *, round((x1 + x2) / 2 / 120.0::double, 3) as cx, round((y1 + y2) / 2 / 140.0::double, 3) as cy from d where label <> 'person' and conf >= 0.35::double),
        ov as (select session, track, max(conf) as conf, last(label order by frame) as label from th group by 1, 2),
        ag as (select th.session, win.first as win_, track, count(distinct frame) as n, min(frame) as f0, max(frame) as f1, first(cx order by frame) as x0_, last(cx order by frame) as x1_, first(cy order by frame) as y0_, last(cy order by frame) as y1_
          from th join win on th.session = win.session and th.frame between win.first and win.last group by 1, 2, 3 having count(distinct frame) >= 2),
        ax as (select *, {_AXES} from ag)
        select session, win_ as "window", track, label, n as frames_present, f0 as first_frame, f1 as last_frame, {DIRECTION} as direction, round(conf, 3) as conf,
          row_number() over (partition by session, win_ order by n desc, f0, track) as nth from ax join ov using (session, track)""",
    "q11_box_geometry": f"""with {D}, z as (select *, round_even(frame * 1.5::double, 0)::bigint as s, (x2::int - x1::int) as wi, (y2::int - y1::int) as hi from d)
        select event_id, round((x1 + x2) / 2 / 120.0::double, 3) as cx, round((y1 + y2) / 2 / 140.0::double, 3) as cy,
        round(greatest(0.0::double, least(1.0::double, x1 / 120.0::double)), 4) as n0, round(greatest(0.0::double, least(1.0::double, y1 / 140.0::double)), 4) as n1,
        round(greatest(0.0::double, least(1.0::double, x2 / 120.0::double)), 4) as n2, round(greatest(0.0::double, least(1.0::double, y2 / 140.0::double)), 4) as n3,
        least(100, x1::int) as cx1, least(100, y1::int) as cy1, least(100, x2::int) as cx2, least(100, y2::int) as cy2, least(100, x2::int) - least(100, x1::int) >= 4 and least(100, y2::int) - least(100, y1::int) >= 4 as crop_ok,
        x1::int + trunc(wi * 0.18::double)::int as tx1, y1::int + trunc(hi * 0.42::double)::int as ty1, x2::int - trunc(wi * 0.18::double)::int as tx2, y1::int + trunc(hi * 0.82::double)::int as ty2,
        format('{{:02d}}:{{:02d}}:{{:02d}}', s // 3600, s % 3600 // 60, s % 60) as clock from z""",
    "q12_iou_prev_frame": f"""with {D} select a.session, a.frame, a.track, round(case when b.frame is null then -1.0::double else {_iou("a", "b")} end, 6) as iou
        from d a left join d b on a.session = b.session and a.track = b.track and b.frame = a.frame - 1""",
    "q13_iou_best_match": f"""with {D}, m as (select a.session, a.frame, a.track, b.track as other, {_iou("a", "b")} as iou from d a join d b on a.session = b.session and a.frame = b.frame and a.label = 'person' and b.label <> 'person'),
        n as (select *, row_number() over (partition by session, frame, track order by iou desc, other) as nth from m where iou > 0.3::double) select session, frame, track, other, round(iou, 6) as iou from n where nth = 1""",
    "q14_interval_overlap_pairs": f"""with {IV} select a.subject, a.track as a, b.track as b, least(a.last, b.last) - b.first + 1 as shared from iv a join iv b
        on a.subject = b.subject and (b.first > a.first or (b.first = a.first and b.track > a.track)) and b.first <= a.last""",
    "q15_interval_first_fit": f"""with recursive {IV}, i1 as (select 's' || (subject % 25) as session, *, row_number() over (partition by subject order by first, last, track) as i from iv),
        w as (select session, subject, track, i, [last] as ends, 0::bigint as part from i1 where i = 1
          union all select session, subject, track, i, case when pos is null then list_append(ends, last) else list_transform(ends, lambda e, j: case when j = pos then last else e end) end, coalesce(pos - 1, len(ends))::bigint
          from (select x.*, w.ends, list_position(list_transform(w.ends, lambda e: e < x.first), true) as pos from w join i1 x on x.subject = w.subject and x.i = w.i + 1)),
        ex as (select distinct session, subject, part from w where part > 0), tp as (select session, max(subject) as top from i1 group by 1),
        nw as (select ex.session, subject, part, top + row_number() over (partition by ex.session order by subject, part) as ns from ex join tp using (session))
        select w.session, w.track, w.subject, w.part, coalesce(nw.ns, w.subject) as new_subject, w.subject in (select subject from ex) as split from w left join nw using (session, subject, part)""",
    "q16_trajectory_direction": f"""with {D}, c as (select session, track, frame, round((x1 + x2) / 2 / 120.0::double, 3) as x, round((y1 + y2) / 2 / 140.0::double, 3) as y from d),
        l as (select session, track, list({{'f': frame, 'x': x, 'y': y}} order by frame) as p, count(*) as n from c group by 1, 2),
        m as (select *, p[1].x as x0_, p[-1].x as x1_, p[1].y as y0_, p[-1].y as y1_, p[n // 2 + 1] as mid from l), ax as (select *, {_AXES} from m)
        select session, track, n as n_points, {DIRECTION} as direction, mid.f as mid_frame, mid.x as mid_x, mid.y as mid_y from ax""",
    "q17_quality_gate_reasons": f"""with {D}, r as (select *, case when (x2 - x1) * (y2 - y1) < 1600 then 'too_small' when quality < 20 then 'too_blurry' when (y2 - y1) / (x2 - x1) < 0.8::double or (y2 - y1) / (x2 - x1) > 4.0::double then 'bad_aspect_ratio' end as reason from d)
        select session, frame, track, reason, reason is null as ok from r""",
    "q18_face_quality_tree": f"""with {D}, {FACE}, z as (select *, q0 as quality, eligibility = 'direct' and category = 'clear' as can_enroll from f3)
        select event_id, frontal, yaw, pitch, category, defects, reason, quality, eligibility, can_enroll,
        case when eligibility <> 'direct' then 'face_not_direct' when category <> 'clear' then 'face_not_clear' end as gallery_reason,
        case when quality >= 0.75::double then '高' when quality >= 0.55::double then '中' when quality > 0 then '低' else '无' end as band from z""",
    "q19_knn_shots": f"with {KNN} select query, row, subject, round(score, 6) as score, nth from kn",
    "q20_subject_candidates": f"with {KNN}, {CAND} select query, subject, round(score, 6) as score, votes, shots, best_row from ca",
    "q21_identity_decision": f"""with {KNN}, {CAND}, rk as (select *, row_number() over (partition by query order by score desc, votes desc, subject) as nth, sum(case when score >= 0.25::double then votes else 0 end) over (partition by query) as high from ca),
        b as (select a.query, a.subject, a.score, a.votes, a.high, s.score as second, s.votes as sv from rk a left join rk s on s.query = a.query and s.nth = 2 where a.nth = 1),
        c as (select *, score >= 0.3::double and high > 0 and votes::double / high < 0.5::double as split from b),
        e as (select *, score >= 0.3::double and not split and second is not null and score - second < 0.01::double and votes <= sv as close from c),
        f as (select *, case when score < 0.2::double then 'new' when score < 0.3::double or split or close then 'grey' else 'hit' end as decision from e)
        select query, decision, case when decision = 'hit' then subject end as subject, round(score, 6) as score, round(score - second, 6) as margin,
        case when split then 'topk_vote_inconsistent' when close then 'top1_margin_too_small' when score >= 0.2::double and score < 0.3::double then 'score_between_thresholds' else 'top1_score' end as reason from f""",
    "q22_rank_k": f"""with {KNN}, h as (select query, unnest([1, 5, 10]) as k, truth, list({{'n': nth, 's': subject}}) as l from kn group by query, truth)
        select k::bigint as k, count(*) as n_probe, round(avg((len(list_filter(l, lambda z: z.n <= k and z.s = truth)) > 0)::int) * 100, 2) as rate from h group by k""",
    "q23_subject_centroid": """with v as (select label::bigint as subject, embedding::double[] as vec from embeddings), u as (select subject, unnest(vec) as x, generate_subscripts(vec, 1) - 1 as dim from v),
        m as (select subject, dim, avg(x) as x, count(*) as n from u group by 1, 2), z as (select subject, sqrt(sum(x * x)) as z from m group by 1)
        select subject, n, dim::int as dim, round(case when z > 0 then x / z else x end, 6) as x from m join z using (subject)""",
    "q24_weighted_fusion_vec": """with v as (select label::bigint as subject, case when label = 3 then 0.0::double else greatest(0.0::double, least(1.0::double, (vec_id % 7)::double / 5.0::double)) end as w, embedding::double[] as vec from embeddings),
        u as (select subject, w, unnest(vec) as x, generate_subscripts(vec, 1) - 1 as dim from v),
        m as (select subject, dim, case when sum(w) > 0 then sum(w * x) / sum(w) else avg(x) end as x from u group by 1, 2), z as (select subject, sqrt(sum(x * x)) as z from m group by 1)
        select subject, dim::int as dim, round(case when z > 0 then x / z else x end, 6) as x from m join z using (subject)""",
    "q26_stitch_static": """with t as (select 's' || (vec_id // 100) as session, vec_id as track, case when vec_id % 3 <> 0 then label::bigint end as subject, vec_id * 37 % 500 as first, vec_id * 37 % 500 + vec_id % 11 as last, embedding::double[] as vec, vec_id % 2 = 0 as ok from embeddings),
        u as (select session, subject, unnest(vec) as x, generate_subscripts(vec, 1) as dim from t where subject is not null), m as (select session, subject, dim, avg(x) as x from u group by 1, 2, 3),
        c as (select session, subject, list(x order by dim) as mean from m group by 1, 2), cn as (select session, subject, list_transform(mean, lambda x: x / sqrt(list_dot_product(mean, mean))) as mean from c),
        pr as (select t.session, t.track, t.ok, cn.subject, list_dot_product(t.vec, cn.mean) / sqrt(list_dot_product(t.vec, t.vec)) as s from t join cn on t.session = cn.session where t.subject is null
          and not exists (select 1 from t k where k.session = t.session and k.subject = cn.subject and k.first <= t.last and t.first <= k.last)),
        b as (select *, row_number() over (partition by session, track order by s desc, subject) as r from pr) select session, track, subject, round(s, 4) as score from b where r = 1 and s >= case when ok then 0.05::double else 0.1::double end""",
    "q27_cross_route_components": f"with recursive {R}, {COMPONENTS} select session, track, component, count(*) over (partition by session, component) as n_tracks from co",
    "q28_identity_confidence": f"""with {R}, {FUSED} select session, track, round(c, 4) as confidence, c >= 0.5::double as resolved, multi_source, agreed,
        case when best > 0 then case when fs * fw = best then 'face' when bs * 0.3::double = best then 'body' else 'gait' end end as "primary",
        concat_ws(',', case when fa then 'face' end, case when ba then 'body' end, case when ga then 'gait' end) as cues from x5""",
    "q29_person_rollup": f"""with recursive {R}, {COMPONENTS}, {MERGED}, {RESOLVED},
        g as (select session, coalesce('subject:' || subject, 'track:' || track) as person, count(*) as n_tracks, string_agg(track::varchar, ',' order by track) as tracks, first(track order by coalesce(score, -1) desc, first, track) as track0,
          first(score order by coalesce(score, -1) desc, first, track) as score0, first(decision order by coalesce(score, -1) desc, first, track) as decision0, bool_or(split) as ws, bool_or(decision in ('local', 'local_stitched')) as lo,
          list(merge_routes) as mr, min(first) as first0 from rs group by 1, 2)
        select session, person, n_tracks, tracks, track0 as track, case when score0 > 0 then round(score0, 4) end as score, case when n_tracks = 1 then decision0 when lo then 'local_stitched' when ws then 'conflict_split' else 'hit' end as decision,
        not (lo or ws) as reused, array_to_string(list_filter(list_sort(list_distinct(string_split(array_to_string(mr, ','), ','))), lambda z: z <> ''), ',') as merge_routes, first0 as first from g""",
    "q30_subject_gallery": f"""with recursive {R}, {COMPONENTS}, {MERGED}, {RESOLVED} select session, coalesce(subject::varchar, '?') as subject, count(*) as n_tracks, bool_or(cross_merged) as any_merged, max(score) as best_score,
        first(track order by score desc, track) as best_track from rs group by 1, 2""",
    "q31_keyframe_events_ctx": f"""with recursive {D}, {FRAMES}, {WINDOWS}, {WFRAMES},
        bt as (select distinct session, win_, frame from (select *, row_number() over (partition by session, win_, track order by quality desc, frame) as r from wd) where r = 1)
        select session, win_ as "window", frame, has_event, max(has_event::int) over (partition by session, win_ order by frame rows between 1 preceding and 1 following) = 1 as near, bt.frame is not null as best from wf left join bt using (session, win_, frame)""",
    "q32_keyframe_even_pick": f"""with recursive {D}, {FRAMES}, {WINDOWS}, {WFRAMES},
        l as (select session, win_, list(frame order by frame) as ev, coalesce(list(frame order by frame) filter (has_event), []) as must, coalesce(list(frame order by frame) filter (not has_event), []) as rest from wf group by 1, 2),
        r as (select *, 12 - len(must) as room from l),
        c as (select session, win_, case when len(ev) <= 12 then ev when room <= 0 then {EVEN.format(x="must", k="12")} else list_concat(must, {EVEN.format(x="rest", k="room")}) end as pick from r)
        select session, win_ as "window", unnest(pick) as frame from c""",
    "q35_spatial_grounding": f"""with recursive {D}, {FRAMES}, {WINDOWS}, {WFRAMES}, {GROUNDED} select session, win_ as "window", frame, track, label, n1, n2, n3, n4, cx, cy from gc""",
    "q36_scene_text_static": r"""with l as (select source as session, doc_id as frame, unnest(string_split(coalesce(text, ''), chr(10))) as text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as line from documents),
        k as (select session, frame, line, regexp_replace(text, '^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$', '', 'g') as text, lower(regexp_replace(text, '[\s\x0B\x1C-\x1F\x85\p{Z}]+', '', 'g')) as key from l), f as (select * from k where key <> ''),
        n as (select session, count(distinct frame) as n_frames from f group by 1), g as (select session, key, count(distinct frame) as n_seen, first(text order by frame, line) as display from f group by 1, 2)
        select session, md5(key) as key, n_seen, n_frames, n_frames >= 2 and n_seen >= greatest(2, floor(n_frames * 0.6::double)) as static, display from g join n using (session)""",
    "q37_roster": """select role || '#' || (conv_id % 20) as subject, string_agg(conv_id || '~' || turn, ', ' order by conv_id * 1000 + turn, conv_id || '~' || turn) as ranges, count(*) as n from conversations group by 1""",
    "q38_timeline_text": """with t as (select conv_id, turn, role, text, turn % 3 = 2 as ab from conversations),
        w as (select conv_id, min(turn) as b, max(turn) as e, case when bool_or(ab) then 'alert' when count(*) > 2 then 'attention' else 'normal' end as level, first(text order by turn, text) as s,
          string_agg('  - t' || turn || ' ' || role || '：' || case when ab then '⚠' else '' end || text, chr(10) order by turn, '  - t' || turn || ' ' || role || '：' || case when ab then '⚠' else '' end || text) as lines, count(*) as n_lines from t group by 1)
        select conv_id as "window", '[窗' || conv_id || ' ' || b || '~' || e || '] 告警=' || level || case when conv_id % 2 = 0 and s <> '' then chr(10) || '  概述：' || s else '' end || chr(10) || lines as text, n_lines from w""",
    "q39_max_alert": f"with {D} select session, track, ['normal', 'attention', 'alert'][max(case when k >= 97 then 3 when k >= 85 then 2 else 1 end)] as level, count(*) as n from o group by 1, 2",
    "q40_accuracy_grouping_sets": """select lang as route, source as bin, sum((quality = 1)::int)::bigint as correct, count(*) as total, round(sum((quality = 1)::int)::double * 100 / count(*), 2) as rank1
        from labels join documents using (doc_id) group by grouping sets ((lang, source), (lang))""",
    "q41_calibration_curve": """with c as (select lang, n_chars as threshold, count(*) as n, sum((quality = 1)::int) as g from labels join documents using (doc_id) group by 1, 2),
        r as (select *, sum(n) over w as kept, sum(g) over w as r0, sum(n) over (partition by lang) as t from c window w as (partition by lang order by threshold desc))
        select lang, threshold, kept::bigint as kept, round(r0::double / kept::double, 6) as precision, round(kept::double / t::double, 6) as coverage from r""",
    "q42_paired_transitions": """with a as (select doc_id, quality = 1 as r1, (quality + doc_id) % 3 = 1 as r2, toxic <> 0 as imp, (doc_id % 10)::double / 10.0::double as c1, (doc_id % 7)::double / 7.0::double as c2 from labels)
        select count(*) as paired, count(*) filter (r1 <> r2) as changed, count(*) filter (not r1 and r2) as improved, count(*) filter (r1 and not r2) as degraded,
        count(*) filter (not (imp and c1 >= 0.5) and imp and c2 >= 0.5) as false_accept_up, count(*) filter (imp and c1 >= 0.5 and not (imp and c2 >= 0.5)) as false_accept_down from a""",
    "q43_coverage_audit": """with p as (select doc_id as id from labels union select -1 - item_id from benchmark) select doc_id as id, 'missing' as status from documents where doc_id not in (select id from p) group by 1
        union all select id, 'extra' from p where id not in (select doc_id from documents)""",
    "q44_route_semijoin_gate": f"""with {D} select session, frame, track, event_id from d where exists (select 1 from (select session, track from d group by 1, 2 having count(distinct frame) >= 3) l where l.session = d.session and l.track = d.track)
        and not exists (select 1 from d z where z.k = 0 and z.session = d.session and z.track = d.track)""",
    "q45_id_switch_diag": f"""with {D}, s as (select session, frame, list(distinct track) as ids from d group by 1, 2), l as (select *, lag(ids) over (partition by session order by frame) as b from s)
        select session, frame, len(list_filter(ids, lambda i: not list_contains(coalesce(b, []), i)))::bigint as n_new, len(list_filter(coalesce(b, []), lambda i: not list_contains(ids, i)))::bigint as n_lost,
        b is not null and len(list_filter(ids, lambda i: not list_contains(b, i))) > 0 as switched from l""",
    "q46_dominant_value": f"""with {D}, c as (select session, track, ['person', 'car', 'truck', 'bus', 'backpack'][k % 5 + 1] as v, count(*) as n from o group by 1, 2, 3),
        g as (select session, track, sum(n)::bigint as total, first(v order by n desc, v desc) as a, first(v order by n desc, v desc) filter (v not in ('bus', 'truck')) as cv, max(n) filter (v not in ('bus', 'truck')) as cn from c group by 1, 2)
        select session, track, total, case when cn >= total * 0.25::double then cv else a end as dominant from g""",
    "q47_session_window_stream": """with e as (select event_type as session, ts, case when ts - lag(ts) over w <= interval 30 minutes then 0 else 1 end as st from events window w as (partition by event_type order by ts)),
        s as (select *, sum(st) over (partition by session order by ts) as g from e) select session, epoch_us(min(ts)) as start_us, epoch_us(max(ts) + interval 30 minutes) as end_us, count(*) as n from s group by session, g""",
    "q51_seeded_sample": """with r as (select user_id as pid, event_id from events), p as (select pid from (select distinct pid from r) order by md5('seed|' || pid), pid limit 20),
        n as (select *, row_number() over (partition by pid order by md5('seed|' || event_id), event_id) as n from r where pid in (select pid from p)) select pid, event_id from n where n <= 3""",
    "q52_cross_route_subjects": f"with recursive {R}, {COMPONENTS}, {MERGED} select session, track, subject, merge_routes, merge_agree, cross_merged from me",
    "q33_keyframes_full": f"""with recursive {D}, {FRAMES}, {WINDOWS}, {WFRAMES},
        bt as (select distinct session, win_, frame from (select *, row_number() over (partition by session, win_, track order by quality desc, frame) as r from wd) where r = 1),
        sf as (select session, frame, sum(k)::double / 40.0::double as a, max(x1) / 20.0::double as b from d group by 1, 2),
        x as (select wf.session, wf.win_, wf.frame, wf.has_event, max(wf.has_event::int) over v = 1 or bt.frame is not null as keep, a, b, row_number() over (partition by wf.session, wf.win_ order by wf.frame) as i
          from wf left join bt using (session, win_, frame) left join sf on sf.session = wf.session and sf.frame = wf.frame window v as (partition by wf.session, wf.win_ order by wf.frame rows between 1 preceding and 1 following)),
        f as (select session, win_, i, frame, has_event, a as la, b as lb, true as took from x where i = 1
          union all select session, win_, i, frame, has_event, case when skip then la else a end, case when skip then lb else b end, not skip
          from (select x.*, f.la, f.lb, not x.keep and f.la is not null and x.a is not null and coalesce(greatest(0.0::double, 1 - (1 + f.la * x.a + f.lb * x.b) / (sqrt(1 + f.la * f.la + f.lb * f.lb) * sqrt(1 + x.a * x.a + x.b * x.b))) < 0.06::double, false) as skip
            from f join x on x.session = f.session and x.win_ = f.win_ and x.i = f.i + 1)),
        l as (select session, win_, list(frame order by frame) as ev, coalesce(list(frame order by frame) filter (has_event), []) as must, coalesce(list(frame order by frame) filter (not has_event), []) as rest from f where took group by 1, 2),
        r as (select *, 12 - len(must) as room from l),
        c as (select session, win_, case when len(ev) <= 12 then ev when room <= 0 then {EVEN.format(x="must", k="12")} else list_concat(must, {EVEN.format(x="rest", k="room")}) end as pick from r)
        select session, win_ as "window", unnest(pick) as frame from c""",
    "q34_temporal_nms": f"""with recursive {D}, x as (select session, track, {{'s': quality, 'f': -frame}} as c, row_number() over (partition by session, track order by frame) as i from d),
        w as (select session, track, i, [c] as held from x where i = 1
          union all select session, track, i, h4 from (select *, case when len(v) < 4 or len(h3) >= 3 or len(list_filter(h3, lambda y: abs(y.f - v[4].f) < 30)) > 0 then h3 else list_append(h3, v[4]) end as h4
            from (select *, case when len(v) < 3 or len(list_filter(h2, lambda y: abs(y.f - v[3].f) < 30)) > 0 then h2 else list_append(h2, v[3]) end as h3
            from (select *, case when len(list_filter([v[1]], lambda y: abs(y.f - v[2].f) < 30)) > 0 then [v[1]] else [v[1], v[2]] end as h2
            from (select x.session, x.track, x.i, list_reverse_sort(list_append(w.held, x.c)) as v from w join x on x.session = w.session and x.track = w.track and x.i = w.i + 1))))),
        z as (select session, track, arg_max(held, i) as held from w group by 1, 2), y as (select session, track, unnest(held) as c, generate_subscripts(held, 1) - 1 as nth from z)
        select session, track, -c.f as frame, c.s as score, nth::bigint as nth from y""",
    "q48_payload_json": f"""with q as (with recursive {D}, {FRAMES}, {SPANS}, {EVENTS}, {WINDOWS},
        di as (select win.session, win.first, count(*) as nd, count(distinct track) as nt, max(quality) as bq from win join d on d.session = win.session and d.frame between win.first and win.last group by 1, 2),
        ei as (select win.session, win.first, string_agg(distinct split_part(event, ':', 1), ',' order by split_part(event, ':', 1)) as kinds, count(*) as ne from win join ev on ev.session = win.session and ev.frame between win.first and win.last group by 1, 2)
        select session, first, last, n_frames, coalesce(nd, 0) as n_detections, coalesce(nt, 0) as n_tracks, bq as best_quality, coalesce(kinds, '') as kinds, coalesce(ne, 0) as n_events from win left join di using (session, first) left join ei using (session, first)) select session, first // 4096 as part, '[' || string_agg('{{"first":' || first || ',"last":' || last || ',"n_frames":' || n_frames || ',"n_detections":' || n_detections || ',"n_tracks":' || n_tracks ||
          case when best_quality is null then '' else ',"best_quality":' || best_quality end || ',"kinds":"' || kinds || '","n_events":' || n_events || '}}', ',' order by first) || ']' as payload, count(*) as n_windows from q group by 1, 2""",
    "q49_face_association": f"with recursive {D}, {ASSOCIATED} select session, frame, face, track, score from asso",
    "q53_face_evidence": f"""with recursive {D}, {ASSOCIATED}, bq as (select *, quality * least(1.0::double, (x2 - x1) * (y2 - y1) / 20000.0::double) as bq from d),
        be as (select session, track, frame as best_frame, track % 13 = 0 as skipped from (select *, row_number() over (partition by session, track order by bq desc, frame) as r from bq) where r = 1),
        ca as (select session, track, frame from (select *, row_number() over (partition by session, track order by quality desc, frame) as r from d where track % 7 <> 0) where r <= 3 union select session, track, best_frame from be where track % 7 = 0),
        fa as (select session, frame, track as face, k::double / 100.0::double as det, (k % 11)::double / 10.0::double as quality, k % 3 + 1 as ck, ['poor', 'marginal', 'clear'][k % 3 + 1] as category, [1, 2, 3, 3][k % 4 + 1] as ek, ['unusable', 'recoverable', 'direct', 'direct'][k % 4 + 1] as eligibility, k % 2 = 0 as restored from d),
        op as (select ca.session, ca.track, ca.frame, asso.face, asso.score as association, fa.* exclude (session, frame, face) from ca join be using (session, track) join asso on asso.session = ca.session and asso.frame = ca.frame and asso.track = ca.track
          join fa on fa.session = asso.session and fa.frame = asso.frame and fa.face = asso.face where not be.skipped),
        ch as (select * from (select *, row_number() over (partition by session, track order by ek desc, ck desc, quality desc, association desc, det desc, frame) as r from op) where r = 1),
        ve as (select session, track, frame, (k % 7)::double - 3.0::double as a, (track % 5)::double - 2.0::double as b from d where k % 10 <> 0),
        al as (select be.session, be.track, skipped, best_frame, ch.* exclude (session, track, r), v1.a as a1, v1.b as b1, v2.a as a2, v2.b as b2 from be left join ch using (session, track) left join ve v1 on v1.session = be.session and v1.track = be.track and v1.frame = best_frame
          left join ve v2 on v2.session = be.session and v2.track = be.track and v2.frame = ch.frame),
        co as (select *, (a1 * a2 + b1 * b2 + 1) / (sqrt(a1 * a1 + b1 * b1 + 1) * sqrt(a2 * a2 + b2 * b2 + 1)) as cs from al),
        st as (select *, case when frame is null then null when frame = best_frame then 'same_frame' when a1 is null then 'body_embedding_unavailable' when a2 is null then 'person_crop_unavailable' when cs >= 0.82::double then 'passed' else 'failed' end as consistency from co),
        ms as (select *, coalesce(consistency in ('same_frame', 'passed'), false) as good from st),
        mt as (select *, case when not good then 'none' when eligibility = 'direct' then 'original' when eligibility = 'recoverable' and restored then 'superres' else 'none' end as match_source from ms),
        mr as (select *, case when match_source = 'superres' then 'restored_face_not_enrollable' when eligibility <> 'direct' then 'face_not_direct' when category <> 'clear' then 'face_not_clear' end as reason from mt)
        select session, track, case when skipped then 'track_skipped' when frame is null then 'not_detected' when not good then 'track_consistency_failed' else 'observed' end as status, frame, face, eligibility, category, quality, association, consistency,
        case when consistency = 'same_frame' then 1.0::double when consistency in ('passed', 'failed') then round(cs, 4) end as consistency_score, match_source, good and match_source <> 'none' as match_ready, good and match_source = 'original' and reason is null as can_enroll,
        case when good then reason end as gallery_reason from mr""",
    "q54_best_face": f"""with {D}, f as (select session || '/' || frame as image, track as face, (k % 11)::double / 10.0::double as quality from d where k % 4 <> 0),
        r as (select *, row_number() over (partition by image order by quality desc, face) as r from f) select image, face, quality from r where r = 1""",
    "q55_merge_decisions": f"""with recursive {R}, {COMPONENTS}, {MERGED} select session, track, subject, case when cross_merged and n % 4 not in (0, 1) then 'merged' else case n % 4 when 0 then 'hit' when 1 then 'stitched' when 2 then 'grey' end end as decision,
        cross_merged or n % 6 = 0 as reused, merge_routes, merge_agree from me""",
    "q56_route_subjects": f"""with recursive {R}, {COMPONENTS}, {MERGED}, z as (select me.session, me.track, me.subject, me.n, ro.body, ro.face, ro.gait from me join ro using (session, track) where subject is not null)
        select session, track, 'body' as route, subject from z where body is not null union all select session, track, 'gait', subject from z where gait is not null
        union all select session, track, 'face', subject from z where face is not null and n % 2 = 0 and n % 3 <> 0 and n % 7 <> 0 and n % 4 <> 3 and n % 5 <> 0""",
    "q57_object_text": f"""with recursive {D}, {WINDOWS}, {OBJECTS} select session, win_ as "window", text, omitted from ot""",
    "q58_grounding_text": f"""with recursive {D}, {FRAMES}, {WINDOWS}, {WFRAMES}, {GROUNDED}, gr as (select *, row_number() over (partition by session, win_, frame order by track) as r from gc)
        select session, win_ as "window", frame, string_agg(label || '#' || track || ' bbox_norm=[' || n1 || ', ' || n2 || ', ' || n3 || ', ' || n4 || '] center=[' || cx || ', ' || cy || ']', chr(10) order by track) filter (r <= 24) as text,
        count(*) as n_objects, greatest(count(*) - 24, 0) as omitted from gr group by 1, 2, 3""",
    "q59_window_persons": f"""with recursive {D}, {ROUTE_ROWS}, {WINDOWS}, {PERSONS} select session, win_ as "window", person, track, tracks, subject, decision, reused, score, face, gait, fused, merge_routes, array_to_string(box, ',') as box,
        array_to_string(list_transform(path, lambda p: p.x || ',' || p.y), ';') as path from pw""",
    "q60_path_summary": f"""with recursive {D}, {ROUTE_ROWS}, {WINDOWS}, {PERSONS}, s as (select *, points as n, case when points >= 3 then [path[1], path[points // 2 + 1], path[points]] else path end as sh, path[1].x as x0_, path[points].x as x1_, path[1].y as y0_, path[points].y as y1_ from pw),
        a as (select *, {_AXES} from s), z as (select session, win_ as "window", person, track, points, {DIRECTION} as direction, array_to_string(list_transform(sh, lambda p: '[' || p.x || ', ' || p.y || ']'), ' ') as path_sample,
          row_number() over (partition by session, win_ order by track) as nth, greatest(count(*) over (partition by session, win_) - 5, 0) as omitted from a) select * from z where nth <= 5""",
    "q61_identity_lines": f"""with recursive {D}, {ROUTE_ROWS}, {WINDOWS}, {PERSONS}, a as (select *, row_number() over (partition by session, win_ order by track) as nth, case when face is null then '人脸:无/不可用' else concat_ws('·', case when face % 8 = 0 then '人脸命中' else '人脸存在' end, {BAND.format("((face % 10)::double / 10.0::double)")}, case when face % 8 = 0 then 'clear' else 'poor' end) end as c1,
          case when score is not null then '人形ReID·' || {BAND.format("score")} end as c2, case when gait is not null then '步态·' || {BAND.format("((gait % 10)::double / 10.0::double)")} end as c3,
          '融合身份·' || {BAND.format("fused")} || '(' || fused || ')' || case when nt > 1 then '·多路线参与' else '' end || case when merge_routes <> '' then '·来源:' || replace(merge_routes, ',', '+') else '' end as fu,
          nullif(concat_ws('；', case when track % 2 = 0 then '人形证据frame#' || win_ || '@a' end, case when face is not null then '人脸证据frame#' || face || '@b' end), '') as evd from pw),
        l as (select session, win_, nth, '  #' || nth || ' ' || case when track % 11 = 0 then 'n' || track || '（库内身份）' when subject is not null then '主体#' || subject || '（' || case decision when 'new' then '新主体' when 'grey' then '待定' else '已知' end || '）' else '未识别人物' end || '  track=' || track ||
          case when reused then ' ♻回头客' else '' end || '  box=[' || array_to_string(list_transform(box, lambda v: round(v, 1)), ', ') || ']' || chr(10) || '      ' || concat_ws(' | ', fu, concat_ws('；', c1, c2, c3), evd) as line from a)
        select session, win_ as "window", string_agg(line, chr(10) order by nth) as text, count(*) as n_people from l group by 1, 2""",
    "q62_window_requests": f"""with recursive {D}, {FRAMES}, {WINDOWS}, {WFRAMES}, {OBJECTS}, s as (select session, win_, frame, row_number() over (partition by session, win_ order by frame) as i, case when frame % 4 <> 0 then {_clock("frame")} end as c from wf where has_event),
        kf as (select session, win_, count(*) as n, string_agg('[关键帧 ' || i || coalesce(' @ ' || c, '') || ']', chr(10) order by i) as frames from s group by 1, 2)
        select win.session, win.first as "window", coalesce(n, 0) as n_frames, coalesce(frames, '') as frames, n is null as answered, case when n is null then '（无关键帧）' end as summary, ot.text as objects from win left join kf on kf.session = win.session and kf.win_ = win.first
        left join ot on ot.session = win.session and ot.win_ = win.first""",
    "q63_person_rows": f"with {D} select session, frame, track, event_id from o where k % 5 = 0 and track is not null",
    "q65_gait_sequences": f"""with {D} select session, track, count(distinct frame) as n_frames, array_to_string(list_sort(list(distinct frame)), ',') as frames from d group by 1, 2 having count(distinct frame) >= 10""",
    "q67_gallery_with_distractors": """with v as (select vec_id, case when label < 5 then label::bigint else -1 - vec_id end as subject, embedding::double[] as vec from embeddings),
        p as (select q.vec_id as query, s.vec_id as row, s.subject, list_dot_product(q.vec, s.vec) as score from v q, v s where q.vec_id % 100 = 0), r as (select *, row_number() over (partition by query order by score desc, row) as nth from p)
        select query, row, subject, round(score, 6) as score, nth from r where nth <= 10""",
    "q69_gate_classes": f"with {D} select session, frame, track, label from d where label in ('car', 'bus', 'truck')",
    "q68_changing_text": r"""with l as (select source as session, doc_id as frame, unnest(string_split(coalesce(text, ''), chr(10))) as text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as line from documents),
        k as (select session, frame, line, regexp_replace(text, '^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$', '', 'g') as text, lower(regexp_replace(text, '[\s\x0B\x1C-\x1F\x85\p{Z}]+', '', 'g')) as key from l), f as (select * from k where key <> ''),
        n as (select session, count(distinct frame) as n_frames from f group by 1), g as (select session, key, count(distinct frame) as n_seen from f group by 1, 2),
        c as (select f.* from f join n using (session) join g using (session, key) where not (n_frames >= 2 and n_seen >= greatest(2, floor(n_frames * 0.6::double)))),
        u as (select session, frame, key, first(text order by line) as text, min(line) as line from c group by 1, 2, 3), t as (select session, frame, string_agg(text, ' | ' order by line, text) as text from u group by 1, 2),
        z as (select *, row_number() over (partition by session order by frame) as nth, greatest(count(*) over (partition by session) - 24, 0) as omitted from t) select session, frame, text, nth, omitted from z where nth <= 24""",
    "q64_read_text": r"""with l as (select source as session, doc_id as frame, unnest(string_split(coalesce(text, ''), chr(10))) as text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as line from documents),
        c as (select *, (length(text) * 37 % 100)::double / 100.0::double as conf from l), k as (select *, row_number() over (partition by session, frame order by conf desc, line) as nth from c where text <> '' and conf >= 0.5::double)
        select session, frame, line::bigint as line, regexp_replace(text, '^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$', '', 'g') as text, conf, nth from k""",
    "q66_colour_match": f"""with {D}, c as (select event_id, track, (k * 37 % 256)::double as r, (k * 91 % 256)::double as g, (k * 53 % 256)::double as b from o), h as (select *, greatest(r, g, b) as hi, greatest(r, g, b) - least(r, g, b) as span from c),
        u as (select *, case when hi = 0 then 0.0::double else span / hi end as sat, hi / 255 as val, case when span = 0 then 0.0::double when hi = r then (60.0::double * (g - b) / span + 360) % 360 when hi = g then 60.0::double * (b - r) / span + 120 else 60.0::double * (r - g) / span + 240 end as hue from h),
        n as (select *, case when val < 0.2::double then 'black' when sat < 0.15::double and val > 0.8::double then 'white' when sat < 0.15::double then 'gray' when (hue < 45 or hue >= 345) and val < 0.5::double and sat > 0.3::double then 'brown' when hue < 15 or hue >= 345 then 'red'
          when hue < 45 then 'orange' when hue < 65 then 'yellow' when hue < 170 then 'green' when hue < 255 then 'blue' when hue < 290 then 'purple' else 'pink' end as colour from u)
        select event_id, colour, [' Red ', '红', 'green', '绿', '蓝', 'grey', '黑'][track % 7 + 1] as asked, colour = ['red', 'red', 'green', 'green', 'blue', 'grey', 'black'][track % 7 + 1] as matches from n""",
    "q70_threshold_for": """with z as (with c as (select lang, n_chars as threshold, count(*) as n, sum((quality = 1)::int) as g from labels join documents using (doc_id) group by 1, 2),
        r as (select *, sum(n) over w as kept, sum(g) over w as r0, sum(n) over (partition by lang) as t from c window w as (partition by lang order by threshold desc))
        select lang, threshold, kept::bigint as kept, round(r0::double / kept::double, 6) as precision, round(kept::double / t::double, 6) as coverage from r) select lang, min(threshold) as threshold, max(coverage) as coverage from z where precision >= 0.5::double group by 1""",
    "q71_reject_curve": """with z as (with c as (select lang, n_chars as threshold, count(*) as n, sum((quality = 1)::int) as g from labels join documents using (doc_id) group by 1, 2),
        r as (select *, sum(n) over w as kept, sum(g) over w as r0, sum(n) over (partition by lang) as t from c window w as (partition by lang order by threshold desc))
        select lang, threshold, kept::bigint as kept, round(r0::double / kept::double, 6) as precision, round(kept::double / t::double, 6) as coverage from r) select lang, threshold, kept, round(1 - coverage, 6) as rejected, round(1 - precision, 6) as error from z""",
    "q72_object_tracks": f"""with {D} select session, track, min(frame) as first, max(frame) as last, max(conf) as max_conf, last(label order by frame) as label from d where label <> 'person' and conf >= 0.35::double group by 1, 2""",
    "q73_track_paths": f"""with {D} select session, track, string_agg(frame || ':' || x1 || ',' || y1 || ',' || x2 || ',' || y2, ';' order by frame) as boxes, string_agg(frame || ':' || ((x1 + x2) / 2) || ',' || ((y1 + y2) / 2), ';' order by frame) as centres from d group by 1, 2""",
    "q74_gallery_stats": "select label::bigint as subject, count(distinct label) as subjects, count(*) as shots from embeddings group by grouping sets ((label), ())",
    "q75_stage_times": f"""with {D} select session || '/' || ['person', 'car', 'truck', 'bus', 'backpack'][k % 5 + 1] as stage, sum(k)::bigint as total, max(k) as longest from o group by 1""",
    "q76_first_frames": f"""with recursive {D}, {FRAMES}, {WINDOWS}, {WFRAMES}, r as (select *, row_number() over (partition by session, win_ order by frame) as nth from wf) select session, win_ as "window", frame from r where nth <= 12""",
    "q77_text_boxes": f"""with {D}, z as (select event_id, k, track, (k * 7 % 60)::double as a, (k * 13 % 40)::double as b from o)
        select event_id, a - 1 + track % 8 as "left", b + track % 3 as top, a + k % 30 + 2 + track % 8 as "right", b + 10 + track % 3 as bottom from z""",
    "q78_match_source": f"""with {D}, f as (select session, frame, track as face, ['unusable', 'recoverable', 'direct', 'direct'][k % 4 + 1] as e, k % 2 = 0 as r, (k % 11)::double / 10.0::double as q, k::double / 100.0::double as det, x1, y1 from d)
        select session, frame, face, case when e = 'direct' then 'original' when e = 'recoverable' and r then 'superres' else 'none' end as source, q > 0.1::double and q >= 0.3::double as rating_ok,
        case when q <= 0.1::double then 'fiqa_unavailable_or_nonfinite' when q < 0.3::double then 'fiqa_below_poor_threshold' end as why, q * least(1.0::double, (12 + face) * (y1 + 15) / 6000) * greatest(0.0::double, least(1.0::double, det)) * case when x1 = 0 then 0.65::double else 1.0::double end as proxy from f""",
    "q79_parsed_reports": "select event_id, case when event_id % 2 <> 0 and event_id % 7 = 0 then null else json_extract(props, '$.k')::int end as k from events",
    "q80_label_colours": """select p_partkey, case when p_partkey % 9 = 0 then 205 else list_reduce(list_prepend(0::bigint, list_transform(string_split(p_name, ''), lambda c: ascii(c)::bigint)), lambda h, c: (h * 31 + c) % 360) end::bigint as hue,
        'data:text/plain;base64,' || to_base64(encode(p_name)) as uri, p_name as back from part""",
    "q81_labelled_names": r"""with n as (select vec_id, case when vec_id % 4 <> 0 then (vec_id % 300) || '-' else '' end || 'img' || case vec_id % 3 when 0 then '-F' when 1 then '-f' else '' end || case vec_id % 5 when 0 then '.mp4' when 1 then '/../x.MP4' else '.JPG' end as name from embeddings)
        select vec_id, name, lpad(nullif(regexp_extract(name, '^(\d+)-', 1), ''), 4, '0') as pid, regexp_matches(upper(name), '-F\.[A-Z]+$') as marked,
        regexp_matches(lower(name), '\.(mp4|avi|mov|mkv|webm)$') and not contains(name, '/') and not contains(name, '..') as safe from n""",
    "q82_checked_vectors": """with v as (select vec_id, embedding::double[] as v from embeddings) select vec_id, len(list_filter(v, lambda x: not isfinite(x))) = 0 as finite, round(sqrt(list_dot_product(v, v)), 6) as norm, 1.0::double as one from v""",
    "q83_torso_boxes": f"""with {D}, z as (select event_id, x1, y1, x2, y2, x2 - x1 as w, y2 - y1 as h, k % 3 <> 0 as ls, k % 4 <> 0 as rs, track % 3 <> 0 as lh, track % 2 <> 0 as rh from d),
        a as (select *, y1 + h * 0.25::double as ty, case when ls and rs then w * 0.5::double else w * 0.5::double end as wd, case when ls then x1 + w * 0.25::double else x1 + w * 0.75::double end as mid, case when lh or rh then y1 + h * 0.75::double end as hy from z where ls or rs),
        b as (select *, case when ls and rs then x1 + w * 0.25::double else mid - wd * 0.5::double end - wd * 0.1::double as le, case when ls and rs then x1 + w * 0.75::double else mid + wd * 0.5::double end + wd * 0.1::double as ri, coalesce(hy, least(y2, ty + wd * 1.5::double)) as bo from a),
        c as (select event_id, greatest(x1, le) as a1, greatest(y1, ty + h * 0.02::double) as b1, least(x2, ri) as a2, least(y2, bo) as b2, h, wd, hy, ty from b)
        select event_id, round(a1, 4) as x1, round(b1, 4) as y1, round(a2, 4) as x2, round(b2, 4) as y2, case when hy is not null then 'pose_full' else 'pose_shoulders' end as source from c where wd >= 4 and (hy is null or hy > ty + 4) and a2 - a1 >= 4 and b2 - b1 >= greatest(4.0::double, 0.1::double * h)""",
    "q84_adaptive_frames": f"""with recursive {D}, s as (select session, frame, max(k)::double / 100.0::double as scene from o group by 1, 2),
        nx as (select session, frame, least(min(case when scene > 0.97::double then frame end) over (partition by session order by frame rows between 1 following and unbounded following),
          min(frame) over (partition by session order by frame range between 12 following and unbounded following)) as nxt from s),
        w as (select session, min(frame) as frame, 0::bigint as nth from s group by 1 union all select w.session, nx.nxt, w.nth + 1 from w join nx on w.session = nx.session and w.frame = nx.frame where nx.nxt is not null), l as (select session, list(frame order by frame) as fs from w where nth < 300 group by 1) select session, unnest({EVEN.format(x="fs", k="24")}) as frame from l""",
    "q85_exposed_candidates": f"with {KNN}, {CAND}, r as (select query, subject, row_number() over (partition by query order by round(score, 6) desc, votes desc, subject) as nth from ca) select * from r where nth <= 8",
    "q86_sliding_windows_stream": """with e as (select event_type as session, (epoch_us(ts) // 1800000000) * 1800000000 as s from events), w as (select session, s - unnest([0, 1800000000]) as s from e)
        select session, s as start_us, s + 3600000000 as end_us, count(*) as n from w group by 1, 2""",
    "q87_covered_frames": f"with recursive {D}, {WINDOWS} select distinct session, unnest(range(first, last + 1)) as frame from win",
    "q88_manifest_hash": """select c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') as hash from customer""",
    "q89_limited_sampling": f"""with {D}, s as (select session, floor(frame * 600 / 7200.0)::bigint as slot, min(frame) as frame from o group by 1, 2), n as (select *, row_number() over (partition by session order by slot) as r from s)
        select session, slot, frame, round(slot * 7200.0::double, 3) as seconds from n where r <= 40""",
    "q94_object_events": f"""with {D}, {FRAMES}, {SPANS}, {EVENTS}, th as (select session, track, min(frame) as frame, arg_min(label, frame) as label from d where label in ('backpack', 'handbag', 'suitcase', 'car', 'truck', 'bus', 'motorcycle', 'bicycle') and conf >= 0.35::double group by 1, 2)
        select session, frame, event from ev union all select session, frame, 'object_new:' || label || '#' || track from th""",
    "q95_capped_window_stream": f"with recursive {D}, {WINDOWS} select * from win",
    "q96_bootstrap_means": f"{BOOTSTRAP} select draw, round(mean, 6) as mean from bm",
    "q97_bootstrap_interval": f"{BOOTSTRAP} select count(*) as draws, round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.975), 6) as high, round(avg(mean), 6) as centre from bm",
    "q99_scene_context": SCENE_CONTEXT,
    "q100_identity_grounding": f"""with recursive {D}, {ROUTE_ROWS}, {FRAMES}, {WINDOWS}, {WFRAMES}, {STANDING} select session, win_ as "window", frame, track, subject, label, decision, x1 || ',' || y1 || ',' || x2 || ',' || y2 as box,
        n1 || ',' || n2 || ',' || n3 || ',' || n4 as norm, mx || ',' || my as middle from ig""",
    "q101_identity_grounding_text": f"""with recursive {D}, {ROUTE_ROWS}, {FRAMES}, {WINDOWS}, {WFRAMES}, {STANDING}, {PERSONS},
        it as (select session, win_, frame, row_number() over (partition by session, win_, frame order by track) as r, count(*) over (partition by session, win_, frame) as n,
          '  ' || label || ' track=' || track || ' bbox_norm=[' || n1 || ', ' || n2 || ', ' || n3 || ', ' || n4 || '] center=[' || mx || ', ' || my || ']' as item from ig),
        fl as (select wf.session, wf.win_, wf.frame, '- frame#' || wf.frame || ' @ ' || case when wf.frame % 4 <> 0 then {_clock("wf.frame")} else 'None' end || '：' || coalesce(max(n), 0) || ' objects' ||
          coalesce(chr(10) || string_agg(item, chr(10) order by r) filter (r <= 3), '') || case when max(n) > 3 then chr(10) || '  ... ' || (max(n) - 3) || ' more objects omitted' else '' end as text
          from wf left join it on it.session = wf.session and it.win_ = wf.win_ and it.frame = wf.frame where has_event group by 1, 2, 3),
        ft as (select session, win_, string_agg(text, chr(10) order by frame) as text from fl group by 1, 2),
        ps as (select *, points as n, case when points >= 3 then [path[1], path[points // 2 + 1], path[points]] else path end as sh, path[1].x as x0_, path[points].x as x1_, path[1].y as y0_, path[points].y as y1_ from pw),
        pa as (select *, {_AXES} from ps), pl as (select session, win_, row_number() over (partition by session, win_ order by track) as r, count(*) over (partition by session, win_) as m, '- ' || coalesce('subject#' || subject, 'track#' || track) || ' tracks=[' || replace(tracks, ',', ', ') ||
          '] direction=' || {DIRECTION} || ' path=[' || array_to_string(list_transform(sh, lambda p: '[' || p.x || ', ' || p.y || ']'), ', ') || ']' as line from pa),
        pt2 as (select session, win_, '【跨帧轨迹摘要】' || chr(10) || string_agg(line, chr(10) order by r) filter (r <= 5) || case when max(m) > 5 then chr(10) || '... ' || (max(m) - 5) || ' more trajectories omitted' else '' end as text from pl group by 1, 2)
        select coalesce(ft.session, pt2.session) as session, coalesce(ft.win_, pt2.win_) as "window", '【关键帧空间 grounding（坐标辅助理解，不要求模型重新检测）】' || chr(10) || '坐标约定：bbox=[x1,y1,x2,y2] pixels; bbox_norm/center_norm normalized to 0..1 from top-left' ||
          coalesce(chr(10) || ft.text, '') || coalesce(chr(10) || pt2.text, '') as text from ft full join pt2 on ft.session = pt2.session and ft.win_ = pt2.win_""",
    "q103_person_texts": f"""with recursive {D}, {ROUTE_ROWS}, {WINDOWS}, {PERSONS}, t as (select *, case when points >= 3 then [path[1], path[points // 2 + 1], path[points]] else path end as sh, case when track % 3 = 0 then '主色:red' end as colour, case when nt > 1 then '属性:由' || nt || '条轨迹合并(' ||
          case when lo_ then '本视频本地subject' when sp_ then '时间冲突拆分subject' else '同一人' end || ')' || case when merge_routes <> '' then '/跨track印证：' || replace(replace(replace(replace(merge_routes, ',', '+'), 'face', '人脸库'), 'body', '人形库'), 'gait', '步态库') else '' end end as attrs from pw)
        select session, win_ as "window", person, '  轨迹: ' || array_to_string(list_transform(sh, lambda p: '(' || {_hundredths("p.x")} || ',' || {_hundredths("p.y")} || ')'), ' → ') as path, nullif(concat_ws(' | ', colour, attrs), '') as attributes from t""",
    "q104_roster_text": """with t as (select conv_id // 10 as session, '主体#' || (conv_id % 7) as subject, conv_id * 1000 + turn as place, conv_id || '~' || turn as r, role, turn from conversations),
        e as (select session, subject, min(place) as first, string_agg(r, ', ' order by place) as rs from t where role = 'assistant' and turn > 4 group by 1, 2),
        x as (select session, string_agg('- ' || subject || '：出现于 ' || rs, chr(10) order by first) as text, count(*) as n from e group by 1)
        select s.session, coalesce(text, '（无可用身份）') as text, coalesce(n, 0) as n_subjects from (select distinct session from t) s left join x on x.session = s.session""",
    "q102_documents": f"""with recursive {D}, {ROUTE_ROWS}, {FRAMES}, {SPANS}, {EVENTS}, {WINDOWS}, {PERSONS}, {OBJECTS},
        de as (select win.session, win.first as win_, list(distinct event order by event) as events from win join ev on ev.session = win.session and ev.frame between win.first and win.last group by 1, 2),
        dp as (select session, win_, list({{'track': track, 'tracks': list_transform(string_split(tracks, ','), lambda t: t::bigint), 'subject': subject, 'decision': decision, 'score': score, 'box': box}} order by track) as people from pw group by 1, 2),
        dj as (select session, win_, list({{'track': track, 'label': label, 'frames_present': n, 'direction': direction, 'conf': round(conf, 3)}} order by nth) as objects from ob group by 1, 2),
        dw as (select win.session, win.first as win_, {{'window': win.first, 'last': win.last, 'n_frames': win.n_frames, 'events': coalesce(events, []), 'people': coalesce(people, []), 'objects': coalesce(objects, [])}} as w
          from win left join de on de.session = win.session and de.win_ = win.first left join dp on dp.session = win.session and dp.win_ = win.first left join dj on dj.session = win.session and dj.win_ = win.first)
        select session, win_ // 4096 as part, to_json({{'session': session, 'part': win_ // 4096, 'schema': 2, 'size': [120.0::double, 140.0::double], 'windows': list(w order by win_)}})::varchar as document, count(*) as n_windows from dw group by 1, 2""",
}

ORACLES["q98_fallback_candidates"] = f"""with cd as ({ORACLES["q34_temporal_nms"]}), bs as ({ORACLES["q05_track_best_evidence"]}), h as (select session, track, count(*) as n, list(frame) as fs from cd group by 1, 2),
  ex as (select bs.session, bs.track, best_frame as frame, -1.0::double as score, least(coalesce(n, 0), 2)::bigint as nth from bs left join h on h.session = bs.session and h.track = bs.track where n is null or not list_contains(fs, best_frame))
  select cd.* from cd where not exists (select 1 from ex where ex.session = cd.session and ex.track = cd.track and ex.nth = cd.nth) union all select * from ex"""
