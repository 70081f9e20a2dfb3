"""DuckDB SQL of clustering, smoothing and framing: loops as recursive queries, spectra as sums."""

from __future__ import annotations

#: Vectors as sessions: the table that ``queries._vector_sessions`` makes.
VECTORS = """e as (select *, row_number() over (partition by session_id order by obs_id) as rn from (select vec_id % 10 as session_id, vec_id as obs_id, {v} as v, 0.2 + (vec_id % 5) / 6 as w from embeddings))"""
_SQUARED = "list_transform({cs}, lambda c: pow(list_distance(e.v, c), 2))"
_COSINE = "list_transform({cs}, lambda c: 1 - greatest(-1, least(1, list_cosine_similarity(e.v, c))))"
_UNIT = "list_transform({x}, lambda y: y / sqrt(list_dot_product({x}, {x})))"


def k_means(most: int, fixed: bool, cosine: bool = False) -> str:
    """CTEs e and ends (session_id, k, cs, labels): farthest-first seeds, then weighted Lloyd steps, for k = most or all up to it."""
    d = _COSINE if cosine else _SQUARED
    vectors = VECTORS.format(v=_UNIT.format(x="embedding::double[]") if cosine else "embedding::double[]")
    centroid = _UNIT.format(x="m") if cosine else "m"
    return f"""{vectors},
seed as (select session_id, 1 as k, [arg_max(v, {{'w': w, 'o': -obs_id}})] as cs from e group by session_id
  union all select s.session_id, any_value(s.k) + 1, list_append(any_value(s.cs), arg_max(e.v, {{'d': list_min({d.format(cs="s.cs")}) * e.w, 'o': -e.obs_id}})) from seed s join e using (session_id) where s.k < {most} group by s.session_id),
km as (select session_id, k, 0 as it, cs, '' as labels, false as done from seed where {f"k = {most}" if fixed else "true"}
  union all select session_id, k, it + 1, cs2, labels2, labels2 = labels from (
    with a as (select *, list_position(ds, list_min(ds)) as c from (select km.session_id, km.k, km.it, km.cs, km.labels, e.obs_id, e.v, e.w, {d.format(cs="km.cs")} as ds from km join e using (session_id) where not km.done and km.it < 32)),
    x as (select session_id, k, c, i, sum(w * x) / sum(w) as m from (select session_id, k, c, w, unnest(v) as x, generate_subscripts(v, 1) as i from a) group by all),
    m as (select session_id, k, c, list(m order by i) as m from x group by all),
    l as (select session_id, k, any_value(it) as it, any_value(cs) as cs, any_value(labels) as labels, string_agg(c, ',' order by obs_id) as labels2 from a group by session_id, k),
    j as (select l.*, unnest(range(1, l.k + 1)) as c from l)
    select j.session_id, j.k, any_value(it) as it, any_value(labels) as labels, any_value(labels2) as labels2, list(coalesce({centroid}, cs[c]) order by c) as cs2 from j left join m using (session_id, k, c) group by j.session_id, j.k)),
ends as (select * from km where done or it = 32),
far as (select session_id, k, obs_id, rn, w, string_split(labels, ',')[rn]::int as label, {d.format(cs="ends.cs")} as d from ends join e using (session_id))"""


_CONFIDENCE = "case when len(d) < 2 then 1.0 else least(1, greatest(0, 1 - list_sort(d)[1] / greatest(list_sort(d)[2], 1e-12))) end"

FIXED_SQL = f"""with recursive {k_means(4, True)}
select session_id, obs_id, label - 1 as cluster, round(sum(w * d[label]) over (partition by session_id), 6) as cost, round({_CONFIDENCE}, 6) as confidence from far"""

AUTO_SQL = f"""with recursive {k_means(6, False, True)},
c as (select session_id, k, sum(w * d[label]) as cost from far group by all),
n as (select session_id, k, min(n) as least, count(*) as used from (select session_id, k, label, count(*) as n from far group by all) group by all),
g as (select *, lag(cost) over (partition by session_id order by k) as before from c join n using (session_id, k)),
s as (select session_id, min(k) as stop from g where k > 1 and (used < k or least < 2 or (before - cost) / greatest(before, 1e-12) < 0.02) group by session_id)
select g.session_id, g.k as n_clusters, round(g.cost, 6) as cost from g left join s using (session_id) where g.k = coalesce(s.stop - 1, 6)"""

VITERBI_SQL = f"""with recursive {k_means(3, True)},
r as (select session_id, obs_id, rn, w, label, {_CONFIDENCE} * w as strength, list_transform(d, lambda x: greatest(0, x / greatest(list_sort(d)[2], 1e-12)) * w) as emit,
  obs_id * 0.05 as s, lag(obs_id * 0.05 + 0.4) over (partition by session_id order by obs_id) as p from far),
t as (select *, case when greatest(0, s - p) < 0.45 then 1 - greatest(0, s - p) / 0.45 else 0.0 end as scale from r),
dp as (select session_id, 1::bigint as rn, sp, emit[sp] as total, [sp] as path, [null::double] as costs from t, (values (1), (2), (3)) as q(sp) where rn = 1
  union all select session_id, any_value(rn), sp, min(total), arg_min(path, {{'t': total, 'a': a}}), arg_min(costs, {{'t': total, 'a': a}}) from (
    select t.session_id, t.rn, q.sp, dp.sp as a, case when dp.sp = q.sp then 0.0 else 0.35 * scale * (1 - case when label = q.sp then strength else 0 end) end as move,
      dp.total + move + emit[q.sp] as total, list_append(dp.path, q.sp) as path, list_append(dp.costs, move) as costs
    from dp join t on t.session_id = dp.session_id and t.rn = dp.rn + 1, (values (1), (2), (3)) as q(sp)) group by session_id, sp),
best as (select session_id, arg_min(path, {{'t': total, 'a': sp}}) as path, arg_min(costs, {{'t': total, 'a': sp}}) as costs from dp where rn = (select max(rn) from t where t.session_id = dp.session_id) group by session_id)
select session_id, obs_id, 'speaker_' || label as speaker, 'speaker_' || path[rn] as resolved_speaker, label <> path[rn] as changed_by_continuity,
  case when label = path[rn] then round(strength, 6) end as resolved_confidence, round(costs[rn], 6) as transition_cost from t join best using (session_id)"""

GREEDY_SQL = f"""with recursive {k_means(4, True)},
o as (select session_id, label, 'speaker_' || (obs_id % 3 + 1) as name, count(*) as n from far group by all),
known as (select distinct session_id, name from o),
pick as (select session_id, [arg_min({{'c': label, 's': name}}, {{'n': -n, 'c': label, 's': name}})] as got from o group by session_id
  union all select p.session_id, list_append(any_value(p.got), arg_min({{'c': label, 's': name}}, {{'n': -n, 'c': label, 's': name}})) from pick p join o using (session_id)
    where not list_contains(list_transform(p.got, lambda g: g.c), o.label) and not list_contains(list_transform(p.got, lambda g: g.s), o.name) group by p.session_id, p.got),
most as (select session_id, arg_max(got, len(got)) as got from pick group by session_id),
named as (select session_id, unnest(got).c as label, unnest(got).s as name from most),
rest as (select session_id, label, row_number() over (partition by session_id order by label) as r from (select session_id, unnest(range(1, 5)) as label from most) where (session_id, label) not in (select session_id, label from named)),
spare as (select session_id, name, row_number() over (partition by session_id order by name) as r from known where (session_id, name) not in (select session_id, name from named)),
fresh as (select session_id, 'speaker_' || i as name, row_number() over (partition by session_id order by i) + (select count(*) from spare where spare.session_id = m.session_id) as r from most m, range(1, 9) as q(i) where (session_id, 'speaker_' || i) not in (select session_id, name from known)),
other as (select session_id, name, r from spare union all select session_id, name, r from fresh)
select session_id, (label - 1)::int as cluster, name as speaker from (select session_id, label, name from named union all select session_id, label, name from rest join other using (session_id, r))"""

#: Samples of a session: two tones and a rough part, by the session's number and its count of events.
SIGNAL = """sig as (select session_id, i, ((0.05 + 0.001 * (n % 100)) * sin(2 * pi() * (100 + session_id % 300) * i / 16000) + 0.05 * sin(2 * pi() * (900 + session_id % 700) * i / 16000) + ((i * 37 + i * i * 13) % 101 - 50) / 500)::float as x
  from (select user_id as session_id, count(*) as n from events group by user_id), range(0, 1024) as q(i))"""

SPECTRA_SQL = f"""with {SIGNAL},
fr as (select session_id, k, list(x order by i) as x from (select session_id, k, i - 256 * k as i, x from sig join range(0, 3) as q(k) on i >= 256 * k and i < 256 * k + 512) group by all),
y as (select session_id, k, list_transform(x, lambda v, i: (v * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 511))::float)::float::double) as y from fr),
tw as (select b, list(cos(2 * pi() * ((b * i) % 1024) / 1024) order by i) as c, list(sin(2 * pi() * ((b * i) % 1024) / 1024) order by i) as s from range(0, 513) as p(b), range(0, 512) as q(i) group by b),
pw as (select session_id, k, b, pow(list_dot_product(y, c)::float::double, 2) + pow(list_dot_product(y, s)::float::double, 2) as w from y, tw),
tot as (select session_id, k, sum(w) as total, sum(w * b * 15.625) / sum(w) as centroid, least(1, exp(avg(case when b > 0 then ln(sqrt(greatest(w, 1e-20))) end)) / avg(case when b > 0 then sqrt(greatest(w, 1e-20)) end)) as flatness from pw group by all),
spr as (select session_id, k, sqrt(sum(w * pow(b * 15.625 - centroid, 2)) / any_value(total)) as spread from pw join tot using (session_id, k) group by all),
rol as (select session_id, k, min(b) * 15.625 as rolloff from (select session_id, k, b, sum(w) over (partition by session_id, k order by b) as below from pw) join tot using (session_id, k) where below >= total * 0.85 group by all),
ed as (select j, least(512, greatest(0, floor(700 * (pow(10, (m0 + j / 25 * (m1 - m0)) / 2595) - 1) * 1024 / 16000))) as e from (select 2595 * log10(1 + 80 / 700) as m0, 2595 * log10(1 + 8000 / 700) as m1), range(0, 26) as q(j)),
fi as (select a.j as f, b, case when b < m.e then (b - a.e) / (m.e - a.e) else (z.e - b) / (z.e - m.e) end as t from ed a join ed m on m.j = a.j + 1 join ed z on z.j = a.j + 2, range(0, 513) as q(b) where b >= a.e and b < z.e),
mel as (select session_id, k, f, ln(greatest(sum(w * t), 1e-20)) as m from pw join fi using (b) group by all),
cep as (select session_id, k, sum(m) as c0, sum(m * cos(pi() * (f + 0.5) / 24)) as c1, sum(m * cos(pi() * 12 * (f + 0.5) / 24)) as c12, max(case when f = 0 then m end) as m1, max(case when f = 11 then m end) as m12, max(case when f = 23 then m end) as m24 from mel group by all),
bd as (select session_id, k, b, w, max(w) over (partition by session_id, k) as top, sum(w) over (partition by session_id, k) as band from pw where b between 5 and 28),
sc0 as (select bd.session_id, bd.k, bd.b, any_value(bd.w) as w, any_value(top) as top, least(1, any_value(top / band)) as voiced, least(1, sqrt(any_value(bd.w / top))) as presence, sum(h.weight * pw.w) as score
  from bd, (values (1, 1.0), (2, 0.9), (3, 0.6), (4, 0.4)) as h(n, weight) join pw on pw.session_id = bd.session_id and pw.k = bd.k and pw.b = bd.b * h.n group by all),
sc as (select * replace (case when b = 5 and presence < 0.25 then score * presence / 0.25 else score end as score) from sc0),
be as (select session_id, k, arg_max(b, {{'s': score, 'b': -b}}) as best, max(score) as peak, any_value(voiced) as voiced from sc group by all),
ri as (select session_id, k, any_value(best) as best, any_value(peak) as peak, any_value(be.voiced) as voiced, max(case when b = best then presence end) as presence, coalesce(max(case when abs(b - best) > 1 and w >= 0.02 * top then score end), 0) as second,
  max(case when b = best - 1 then score end) as lo, max(case when b = best + 1 then score end) as hi from sc join be using (session_id, k) group by all),
pi0 as (select *, least(1, greatest(0, 0.6 * voiced + 0.25 * presence + 0.15 * case when second > 0 then greatest(0, (peak - second) / peak) else 1 end)) * case when best in (5, 28) then 0.8 else 1 end as sure from ri),
pit as (select session_id, k, voiced, sure, case when voiced >= 0.12 and sure >= 0.15 then (best + case when best in (5, 28) or abs(lo - 2 * peak + hi) <= 1e-20 then 0 else greatest(-0.5, least(0.5, 0.5 * (lo - hi) / (lo - 2 * peak + hi))) end) * 15.625 end as pitch from pi0),
lev as (select session_id, k, sqrt(list_avg(list_transform(x, lambda v: pow(v::double, 2)))) as rms, list_max(list_transform(x, lambda v: abs(v))) as peak, len(list_filter(range(2, 513), lambda i: (x[i] >= 0) <> (x[i - 1] >= 0))) / 511 as zcr, len(list_filter(x, lambda v: abs(v) >= 0.995)) / 512 as clip from fr)
select session_id, (k * 0.016)::double as start_s, round(rms, 5) as rms, round(lev.peak::double, 5) as peak, round(zcr, 5) as zcr, round(clip, 5) as clip, round(centroid, 3) as centroid_hz, round(spread, 3) as spread_hz, rolloff::double as rolloff_hz, round(flatness, 5) as flatness, round(pitch, 3) as pitch_hz, round(sure, 5) as pitch_conf, round(pit.voiced, 5) as voiced_prob,
  round(m1, 4) as mel_1, round(m12, 4) as mel_12, round(m24, 4) as mel_24, round(c0, 4) as mfcc_0, round(c1, 4) as mfcc_1, round(c12, 4) as mfcc_12
from lev join tot using (session_id, k) join spr using (session_id, k) join rol using (session_id, k) join cep using (session_id, k) join pit using (session_id, k)"""
