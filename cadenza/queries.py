"""One query per operator over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import inference_sql as IS
from .config import AcousticConfig, AlignmentConfig, CoherenceConfig, DiarizationConfig, FeatureWeights, GroupingConfig, HybridWeights
from .functions import distribution as D
from .functions import scalars as S
from .functions import text as X
from .functions import vectors as V
from .operators import alignment as A
from .operators import clustering as C
from .operators import coherence as H
from .operators import dsp, joins
from .operators import frames as FR
from .operators import observations as O
from .operators import ordered as R
from .operators import segments as G
from .plans import context as CX
from .plans import diarization as P
from .plans import export as E
from .sources import embeddings as EM
from .sources import signals as SG
from .sources.tables import EVENT_FRAMES_SQL, KEYS, TURNS_SQL, event_frames, event_turns, event_utterances, table
from .streaming import frames as SF
from .streaming import groups as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Settings in hours, as events stand in for frames.
ACOUSTIC = AcousticConfig(silence_rms=0.05)
GROUPING = GroupingConfig(0.25, 12.0, 6.0)
ALIGNMENT = AlignmentConfig(24.0, 3.0, 0.10, 0.10)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


def fields(df: DataFrame, struct: str, prefix: str = "") -> DataFrame:
    """A distribution struct as rounded columns."""
    out = [F.col(f"{struct}.count").alias(f"{prefix}count"), *[F.round(F.col(f"{struct}.{n}"), 6).alias(prefix + n) for n in D.FIELDS[1:]]]
    return df.select(*[c for c in df.columns if c != struct], *out)


DISTRIBUTION_SQL = """count({c}) as count, round(coalesce(min({c}), 0), 6) as minimum, round(coalesce(max({c}), 0), 6) as maximum, round(coalesce(avg({c}), 0), 6) as mean,
  round(coalesce(quantile_cont({c}, 0.5), 0), 6) as median, round(coalesce(stddev_pop({c}), 0), 6) as standard_deviation,
  round(coalesce(quantile_cont({c}, 0.1), 0), 6) as q10, round(coalesce(quantile_cont({c}, 0.25), 0), 6) as q25, round(coalesce(quantile_cont({c}, 0.75), 0), 6) as q75, round(coalesce(quantile_cont({c}, 0.9), 0), 6) as q90"""


# --- distributions and scalars -------------------------------------------------------------------


@query(f"select event_type, {DISTRIBUTION_SQL.format(c='value')} from events group by event_type")
def distribution_by_event_type(spark, sf_dir):
    return fields(table(spark, sf_dir, "events").groupBy("event_type").agg(D.distribution("value").alias("d")), "d")


@query("select user_id, round(avg((value > 40)::int::double), 6) as voiced_fraction from events group by user_id")
def voiced_fraction(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(D.fraction(F.col("value") > 40), 6).alias("voiced_fraction"))


@query(f"""with {EVENT_FRAMES_SQL}
select id, round(case when rms > 1e-12 then peak / rms else 0 end, 6) as crest, round(20 * log10(greatest(rms, 1e-12)), 6) as db,
  round(abs(12 * log2(pitch_hz / (80 + value))), 6) as semitones, round(2595 * log10(1 + centroid_hz / 700), 6) as mel,
  round(700 * (pow(10, (2595 * log10(1 + centroid_hz / 700)) / 2595) - 1), 4) as hz, round(least(1, greatest(0, rms)), 6) as clamped from f""")
def frame_scalars(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    return f.select("id", F.round(S.crest_factor("peak", "rms"), 6).alias("crest"), F.round(S.decibels("rms"), 6).alias("db"), F.round(S.semitones("pitch_hz", 80 + F.col("value")), 6).alias("semitones"), F.round(S.mel("centroid_hz"), 6).alias("mel"), F.round(S.hz(S.mel("centroid_hz")), 4).alias("hz"), F.round(S.clamp01("rms"), 6).alias("clamped"))


@query(f"""with {EVENT_FRAMES_SQL}, t as (select id, start_s, case when id % 7 = 0 then 'nan'::double when id % 11 = 0 then 'infinity'::double else 0.5 end as d from f)
select id, case when isfinite(d) then round(start_s, 6) end as range_start, case when isfinite(d) then round(start_s + d, 6) end as range_end from t""")
def finite_time_ranges(spark, sf_dir):
    d = F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 11 == 0, F.lit(float("inf"))).otherwise(0.5)
    t = event_frames(spark, sf_dir).select("id", S.time_range("start_s", d).alias("r"))
    return t.select("id", F.round("r.start_s", 6).alias("range_start"), F.round("r.end_s", 6).alias("range_end"))


FLOORS_SQL = """floors as (select session_id, case when n >= 4 and high > greatest(0.1, low * 1.5) then low else 0.0 end as noise_floor, n from (
  select session_id, n, max(case when r = floor((n - 1) * 0.1) then rms end) as low, max(case when r = floor((n - 1) * 0.9) then rms end) as high from (
    select session_id, rms, row_number() over (partition by session_id order by rms) - 1 as r, count(*) over (partition by session_id) as n from f) group by session_id, n)),
c as (select f.*, noise_floor, greatest(0.05, noise_floor * 2.5) as quiet from f join floors using (session_id)),
a as (select *, case when rms < quiet then 'silence' when clip > 0.01 then 'uncertain'
  when pitch_hz is not null and voiced_prob >= 0.12 and flatness <= 0.65 and zcr <= 0.35 then 'voicedSpeech'
  when flatness > 0.65 or zcr > 0.35 then 'noise' else 'uncertain' end as activity from c),
q as (select *, least(1, greatest(0, (case when rms < quiet then 0.0 else 1.0 end) - (case when clip > 0.01 then least(0.6, clip * 5) else 0 end)
  - (case when pitch_hz is null then 0.25 else 0 end) - (case when activity = 'noise' then 0.4 else 0 end) - (case when flatness > 0.65 then 0.15 else 0 end) - (case when zcr > 0.35 then 0.15 else 0 end))) as quality_score from a),
u as (select *, activity = 'voicedSpeech' and quality_score >= 0.55 as usable from q)"""


@query(f"with {EVENT_FRAMES_SQL}, {FLOORS_SQL} select session_id, round(noise_floor, 6) as noise_floor, n as n_frames from floors")
def noise_floors(spark, sf_dir):
    return rounded(FR.noise_floors(event_frames(spark, sf_dir), KEYS, config=ACOUSTIC), "noise_floor")


@query(f"with {EVENT_FRAMES_SQL}, {FLOORS_SQL} select round(sum(noise_floor * n) / sum(n), 6) as noise_floor, sum(n)::bigint as n_frames from floors")
def mean_noise_floor(spark, sf_dir):
    return rounded(FR.mean_noise_floor(FR.noise_floors(event_frames(spark, sf_dir), KEYS, config=ACOUSTIC)), "noise_floor")


@query(f"with {EVENT_FRAMES_SQL}, {FLOORS_SQL} select id, activity from u")
def activity_case(spark, sf_dir):
    return FR.classified(event_frames(spark, sf_dir), KEYS, ACOUSTIC).select("id", "activity")


@query(f"""with {EVENT_FRAMES_SQL}, {FLOORS_SQL} select id, round(quality_score, 6) as quality_score, usable, concat_ws(',', case when rms < quiet then 'lowEnergy' end, case when clip > 0.01 then 'clipping' end,
  case when pitch_hz is null then 'unvoiced' end, case when activity = 'noise' then 'noiseLike' end) as issues from u""")
def quality_score(spark, sf_dir):
    f = FR.classified(event_frames(spark, sf_dir), KEYS, ACOUSTIC)
    return f.select("id", F.round("quality_score", 6).alias("quality_score"), "usable", F.concat_ws(",", "issues").alias("issues"))


@query(f"""with {EVENT_FRAMES_SQL}, raw as (select session_id, id, rms > 0.5 as usable from f), enh as (select session_id, id, rms * 1.5 > 0.5 and k > 30 as usable from f where pitch_hz is not null)
select raw.id, raw.usable from raw left join enh using (session_id, id) where raw.usable or coalesce(enh.usable, false)""")
def usable_in_either_view(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    raw = f.select(*KEYS, "id", (F.col("rms") > 0.5).alias("usable"))
    enhanced = f.where("pitch_hz is not null").select(*KEYS, "id", ((F.col("rms") * 1.5 > 0.5) & (F.col("k") > 30)).alias("usable"))
    return joins.usable_in_either(raw, enhanced, [*KEYS, "id"]).select("id", "usable")


# --- ordered operators ---------------------------------------------------------------------------

CONSISTENCY_SQL = """l as (select *, lag(start_s) over w is not null and start_s <= lag(end_s) over w + 1 as follows,
  lag(rms) over w as p_rms, lag(centroid_hz) over w as p_c, lag(spread_hz) over w as p_s, lag(flatness) over w as p_f, lag(mfcc) over w as p_m, lag(pitch_hz) over w as p_p
  from (select *, row_number() over (partition by session_id order by id) as rn from f) window w as (partition by session_id order by id)),
d as (select *, case when follows then abs(20 * log10(greatest(rms, 1e-12)) - 20 * log10(greatest(p_rms, 1e-12))) else 0.0 end as e,
  case when follows then least(1, abs(centroid_hz - p_c) / 1.0 + abs(spread_hz - p_s) / 1.0 + abs(flatness - p_f)) else 0.0 end as sp,
  case when follows then sqrt((pow(mfcc[1] - p_m[1], 2) + pow(mfcc[2] - p_m[2], 2)) / 2) else 0.0 end as mf,
  case when follows and pitch_hz > 0 and p_p > 0 then abs(12 * log2(pitch_hz / p_p)) end as pi from l),
g as (select *, least(1, 0.30 * least(1, e / 18) + 0.35 * sp + 0.25 * least(1, mf / 8) + 0.10 * least(1, coalesce(pi, 0) / 12)) as change from d),
k1 as (select *, 1 - change as consistency, least(1, greatest(change, least(1, e / 18) * sp)) as transient from g)"""


@query(f"""with {EVENT_FRAMES_SQL}, {CONSISTENCY_SQL}
select id, round(e, 6) as energy_delta_db, round(sp, 6) as spectral_delta, round(mf, 6) as mfcc_delta, round(pi, 6) as pitch_delta, round(consistency, 6) as consistency, round(transient, 6) as transient from k1""")
def lag_consistency(spark, sf_dir):
    f = FR.with_consistency(event_frames(spark, sf_dir), KEYS, ["id"], F.lit(1))
    names = ["energy_delta_db", "spectral_delta", "mfcc_delta", "pitch_delta", "consistency", "transient"]
    return rounded(f, *names).select("id", *names)


GROUPS_SQL = """o as (select session_id, id, start_s, end_s, row_number() over (partition by session_id order by id) as rn from f),
walk as (select session_id, rn, id, start_s, end_s, start_s as first_s, 0 as group_no from o where rn = 1
  union all select o.session_id, o.rn, o.id, o.start_s, o.end_s, case when o.start_s - w.end_s > 6.0 or o.end_s - w.first_s > 12.0 then o.start_s else w.first_s end,
  case when o.start_s - w.end_s > 6.0 or o.end_s - w.first_s > 12.0 then w.group_no + 1 else w.group_no end
  from walk w join o on o.session_id = w.session_id and o.rn = w.rn + 1)"""


def _groups(spark, sf_dir) -> DataFrame:
    return R.capped_gap_groups(event_frames(spark, sf_dir).select(*KEYS, "id", "start_s", "end_s", "value"), KEYS, "start_s", "end_s", ["id"], GROUPING.maximum_gap_seconds, GROUPING.maximum_seconds)


@query(f"""with recursive {EVENT_FRAMES_SQL}, {GROUPS_SQL},
g as (select walk.session_id, group_no, min(walk.start_s) as s, max(walk.end_s) as e, count(*) as n_rows, avg(value) as mean, quantile_cont(value, 0.9) as q90 from walk join f on f.id = walk.id group by all having max(walk.end_s) - min(walk.start_s) >= 0.75)
select session_id, row_number() over (partition by session_id order by group_no) - 1 as obs_id, round(s, 6) as start_s, round(e, 6) as end_s, n_rows, round(mean, 6) as mean, round(q90, 6) as q90 from g""")
def capped_gap_sessions(spark, sf_dir):
    spans = R.grouped_spans(_groups(spark, sf_dir), KEYS, "start_s", "end_s", "group_no", 0.75, D.distribution("value").alias("d"))
    out = spans.select(*KEYS, "obs_id", "start_s", "end_s", "n_rows", F.col("d.mean").alias("mean"), F.col("d.q90").alias("q90"))
    return rounded(out, "start_s", "end_s", "mean", "q90")


@query(f"with recursive {EVENT_FRAMES_SQL}, {GROUPS_SQL} select id, group_no from walk")
def stream_accumulator(spark, sf_dir):
    """The same grouping as a stream over the event files, with grouped state."""
    return ST.streamed_groups(spark, sf_dir, GROUPING.maximum_gap_seconds, GROUPING.maximum_seconds)


@query("""with o as (select *, date_diff('microsecond', timestamp '2024-01-01', ts) / 3.6e9 as s from events),
l as (select *, case when row_number() over w = 1 or lag(event_type) over w <> event_type or s - (lag(s) over w + 6.0) > 30.0 then 1 else 0 end as fresh from o window w as (partition by user_id order by event_id)),
i as (select *, sum(fresh) over (partition by user_id order by event_id) - 1 as island from l)
select user_id as session_id, island::bigint as segment_index, any_value(event_type) as speaker, round(min(s), 6) as start_s, round(max(s) + 6.0, 6) as end_s, round(avg(value / 500), 6) as confidence, string_agg(event_id, ',' order by event_id) as ids from i group by user_id, island""")
def segment_merge(spark, sf_dir):
    f = event_frames(spark, sf_dir).select(*KEYS, F.col("id").alias("obs_id"), "event_type", "start_s", (F.col("start_s") + 6.0).alias("end_s"), (F.col("value") / 500).alias("conf"))
    t = G.turns(f, KEYS, "event_type", "conf", 30.0)
    return rounded(t.withColumn("ids", F.array_join(F.transform("observation_ids", lambda x: x.cast("string")), ",")).drop("observation_ids"), "start_s", "end_s", "confidence")


@query(f"""with {EVENT_FRAMES_SQL}, o as (select session_id, id, event_type, start_s as s, start_s + k / 10 as e, case when k >= 50 then 'high' else 'low' end as replay from f where event_type <> 'view'),
t as (select *, sum(turned) over (partition by session_id order by s, e, id) as turn from (select *, case when row_number() over w = 1 or lag(event_type) over w <> event_type or lag(replay) over w <> replay then 1 else 0 end as turned from o window w as (partition by session_id order by s, e, id))),
m as (select *, max(e) over (partition by session_id, turn order by s, e, id rows between unbounded preceding and 1 preceding) as reach from t),
i as (select *, sum(case when reach is null or s - reach > 48.0 then 1 else 0 end) over (partition by session_id order by s, e, id) - 1 as span from m)
select session_id, span::bigint as span, any_value(event_type) as baseline_speaker, any_value(replay) as replay_speaker, round(min(s), 6) as start_s, round(max(e), 6) as end_s, count(*) as n_observations from i group by session_id, span""")
def change_spans(spark, sf_dir):
    f = event_frames(spark, sf_dir).where("event_type <> 'view'").select(*KEYS, "id", "event_type", "start_s", (F.col("start_s") + F.col("k") / 10).alias("end_s"), F.when(F.col("k") >= 50, "high").otherwise("low").alias("replay"))
    return rounded(G.change_spans(f, KEYS, "event_type", "replay", 48.0, ["id"]), "start_s", "end_s")


@query("select event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as new_id from events")
def rebase_ids(spark, sf_dir):
    return R.rebased(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "new_id").select("event_id", "new_id")


# --- noise and reliability -----------------------------------------------------------------------

NOISE_SQL = f"""with {EVENT_FRAMES_SQL}, {FLOORS_SQL}, s as (select *, 0.5 + k / 250 as consistency, k / 300 as transient from u),
p as (select session_id, count(*) as n_noise, quantile_cont(rms, 0.9) as q90, quantile_cont(flatness, 0.5) as fm, quantile_cont(consistency, 0.5) as cm, avg(log_mel[1]) as m1, avg(log_mel[2]) as m2, stddev_pop(log_mel[1]) as d1, stddev_pop(log_mel[2]) as d2 from s where activity in ('silence', 'noise') group by session_id),
v as (select s.*, n_noise, 1 / (1 + pow(rms / greatest(q90, 1e-9), 2)) as le, least(1, greatest(0, flatness / greatest(fm, 0.05))) as fl, least(1, greatest(0, consistency / greatest(cm, 0.10))) as st, case when pitch_hz is null then 1 else 1 - pitch_conf end as pu from s left join p using (session_id)),
w as (select *, case when n_noise > 0 then least(1, greatest(0, 0.40 * fl + 0.15 * le + 0.15 * st + 0.25 * pu + 0.05 * transient)) else 0 end as likelihood from v)"""


def _noisy(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    f = FR.classified(event_frames(spark, sf_dir), KEYS, ACOUSTIC).withColumns({"consistency": 0.5 + F.col("k") / 250, "transient": F.col("k") / 300})
    return f, FR.noise_profiles(f, KEYS)


@query(f"{NOISE_SQL} select f.session_id, coalesce(n_noise, 0) as n_noise, round(q90, 6) as rms_q90, round(fm, 6) as flatness_median, round(m1, 6) as mel_1, round(m2, 6) as mel_2, round(d1, 6) as spread_1, round(d2, 6) as spread_2 from (select distinct session_id from f) f left join p using (session_id)")
def noise_profile(spark, sf_dir):
    _, p = _noisy(spark, sf_dir)
    out = p.select(*KEYS, "n_noise", F.col("noise_rms.q90").alias("rms_q90"), F.col("noise_flatness.median").alias("flatness_median"), *[F.try_element_at("log_mel_mean", F.lit(i)).alias(f"mel_{i}") for i in (1, 2)], *[F.try_element_at("log_mel_dispersion", F.lit(i)).alias(f"spread_{i}") for i in (1, 2)])
    return rounded(out, *out.columns[2:])


@query(f"{NOISE_SQL} select id, round(likelihood, 6) as noise_likelihood, round(case when n_noise > 0 then le else 0 end, 6) as noise_low_energy from w")
def noise_likelihood(spark, sf_dir):
    f, p = _noisy(spark, sf_dir)
    return rounded(FR.noise_evidence(f, p, KEYS).select("id", "noise_likelihood", "noise_low_energy"), "noise_likelihood", "noise_low_energy")


@query(f"""{NOISE_SQL}, m as (select session_id, id // 20 as obs_id, quantile_cont(case when pitch_hz is not null then likelihood end, 0.5) as l, count(pitch_hz) as n_sources from w group by all),
t as (select *, least(1, greatest(0, (l - 0.55) / (0.80 - 0.55))) as x from m)
select session_id, obs_id, round(l, 6) as noise_likelihood, n_sources, round(coalesce(x * x * (3 - 2 * x), 0), 6) as taper, round(coalesce(1 - (1 - 0.2) * x * x * (3 - 2 * x), 1), 6) as reliability from t""")
def reliability_smoothstep(spark, sf_dir):
    f, p = _noisy(spark, sf_dir)
    evidence = FR.noise_evidence(f, p, KEYS).where("pitch_hz is not null")
    obs = f.groupBy(*KEYS, F.floor(F.col("id") / 20).alias("obs_id")).agg(F.collect_list("id").alias("frame_ids"))
    return rounded(FR.reliabilities(obs, evidence, KEYS), "noise_likelihood", "taper", "reliability")


@query("""with m as (select l_returnflag, sum(l_quantity) as w, sum(l_extendedprice * l_quantity) / sum(l_quantity) as m1, sum(l_discount * l_quantity) / sum(l_quantity) as m2, sum(l_tax * l_quantity) / sum(l_quantity) as m3 from lineitem group by all),
d as (select l_returnflag, sqrt(sum(l_quantity * pow(l_extendedprice - m1, 2)) / sum(l_quantity)) as d1, sqrt(sum(l_quantity * pow(l_discount - m2, 2)) / sum(l_quantity)) as d2, sqrt(sum(l_quantity * pow(l_tax - m3, 2)) / sum(l_quantity)) as d3 from lineitem join m using (l_returnflag) group by all)
select l_orderkey, l_linenumber, round((l_extendedprice - m1) / d1, 6) as z1, round((l_discount - m2) / d2, 6) as z2, round((l_tax - m3) / d3, 6) as z3 from lineitem join m using (l_returnflag) join d using (l_returnflag)""")
def weighted_standardize(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity", F.array("l_extendedprice", "l_discount", "l_tax").alias("v"))
    z = FR.standardized(l, ["l_returnflag"], "v", "l_quantity")
    return z.select("l_orderkey", "l_linenumber", *[F.round(F.element_at("standardized", i), 6).alias(f"z{i}") for i in (1, 2, 3)])


@query("""with e as (select p_brand as b, [p_retailprice, p_size::double] as v, p_size::double as w from part), c as (select b, sum(v[1] * w) / sum(w) as c1, sum(v[2] * w) / sum(w) as c2 from e group by b)
select b as brand, round(any_value(c1), 6) as centroid_1, round(any_value(c2), 6) as centroid_2, round(sqrt(sum(w * pow(v[1] - c1, 2)) / sum(w)), 6) as dispersion_1, round(sqrt(sum(w * pow(v[2] - c2, 2)) / sum(w)), 6) as dispersion_2 from e join c using (b) group by b""")
def weighted_centroids(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.array("p_retailprice", F.col("p_size").cast("double")).alias("v"), F.col("p_size").cast("double").alias("w"))
    m = G.weighted_moments(p, ["brand"], "v", "w")
    return m.select("brand", *[F.round(F.element_at(c, i), 6).alias(f"{c}_{i}") for c in ("centroid", "dispersion") for i in (1, 2)])


# --- vectors -------------------------------------------------------------------------------------

PAIRS_SQL = "with p as (select a.vec_id, a.embedding::double[] as a, b.embedding::double[] as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


def _pairs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


@query("select vec_id, round(list_aggregate(list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))), 'sum'), 6) as total, round((embedding::double[])[1] / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as first from embeddings")
def l2_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.l2_normalized("embedding").alias("u"))
    return e.select("vec_id", F.round(V.total(F.col("u")), 6).alias("total"), F.round(F.element_at("u", 1), 6).alias("first"))


@query(f"{PAIRS_SQL} select vec_id, round(1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) as distance from p")
def cosine_distance(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(V.embedding_distance("a", "b"), 6).alias("distance"))


@query(f"{PAIRS_SQL} select vec_id, round((list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) + 1) / 2, 6) as agreement, round(sqrt(list_dot_product(a, a) + list_dot_product(b, b) - 2 * list_dot_product(a, b)) / sqrt(64), 6) as rms_distance from p")
def cosine_agreement(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(V.cosine_agreement("a", "b"), 6).alias("agreement"), F.round(V.rms_distance("a", "b"), 6).alias("rms_distance"))


CENTERS_SQL = "with e as (select vec_id, label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label as c, i, avg(x) as m from e group by all), d as (select vec_id, c, sum(pow(x - m, 2)) as dist from e join m using (i) group by all)"


def _centers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e, FR.elementwise(e, ["label"], "embedding").select(F.col("label").alias("c"), F.col("mean").alias("center"))


@query(f"{CENTERS_SQL} select vec_id, arg_min(c, {{'d': dist, 'c': c}}) as nearest, round(min(dist), 6) as distance from d group by vec_id")
def nearest_centroid(spark, sf_dir):
    e, centers = _centers(spark, sf_dir)
    return rounded(C.nearest_centroid(e, centers, "embedding", "center", "c").select("vec_id", "nearest", "distance"), "distance")


def _distances(spark, sf_dir) -> DataFrame:
    e, centers = _centers(spark, sf_dir)
    model = centers.agg(F.array_sort(F.collect_list(F.struct("c", "center"))).alias("m"))
    return e.crossJoin(F.broadcast(model)).select("vec_id", "label", F.transform("m", lambda x: V.squared_distance("embedding", x["center"])).alias("d"))


SECOND_SQL = f"{CENTERS_SQL}, s as (select vec_id, greatest(list_sort(list(dist))[2], 1e-12) as second, min(dist) as nearest from d group by vec_id)"


@query(f"{SECOND_SQL} select vec_id, c, round(dist / second, 6) as cost from d join s using (vec_id)")
def candidate_costs(spark, sf_dir):
    d = _distances(spark, sf_dir).select("vec_id", F.posexplode(V.candidate_costs("d")).alias("c", "cost"))
    return rounded(d, "cost")


@query(f"{SECOND_SQL} select vec_id, round(least(1, greatest(0, 1 - nearest / second)), 6) as confidence from s")
def assignment_confidence(spark, sf_dir):
    return _distances(spark, sf_dir).select("vec_id", F.round(V.assignment_confidence("d"), 6).alias("confidence"))


@query(f"""{CENTERS_SQL}, t as (select vec_id, c, dist, case when c % 2 = 0 then 1.0 else 0.5 end as other from d), r as (select vec_id, c, 0.35 * dist + 0.65 * other as raw from t),
o as (select vec_id, list_sort(list(raw)) as l, arg_min(c, {{'r': raw, 'c': c}}) as best from r group by vec_id)
select vec_id, best, round(case when l[2] <= 1e-12 then 0 else least(1, greatest(0, 1 - l[1] / l[2])) end, 6) as confidence, round(l[1] / greatest(l[2], 1e-12), 6) as cost from o""")
def hybrid_fusion(spark, sf_dir):
    w = HybridWeights(35, 65)
    other = F.transform("d", lambda x, i: F.when(i % 2 == 0, 1.0).otherwise(0.5))
    raw = _distances(spark, sf_dir).select("vec_id", V.fused_costs("d", other, w.acoustic, w.embedding).alias("raw"))
    return raw.select("vec_id", V.first_argmin("raw").alias("best"), F.round(V.fused_confidence("raw"), 6).alias("confidence"), F.round(F.array_min(V.candidate_costs("raw")), 6).alias("cost"))


@query("""with e as (select label, vec_id, list_transform(embedding::double[], lambda x: (x / sqrt(list_dot_product(embedding::double[], embedding::double[])))::float::double) as u from embeddings),
x as (select label, vec_id, unnest(u) as x, generate_subscripts(u, 1) as i from e), m as (select label, i, avg(x)::float::double as m from x group by all),
n as (select label, list(m order by i) as c from m group by label), z as (select label, list_transform(c, lambda x: (x / sqrt(list_dot_product(c, c)))::float::double) as c from n),
d as (select e.label, 1 - list_dot_product(u, c) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(c, c))) as d from e join z using (label))
select label, count(*) as evidence_count, round(sqrt(avg(d * d)), 4) as dispersion from d group by label""")
def embedding_profile(spark, sf_dir):
    p = G.embedding_profiles(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return p.select("label", "evidence_count", F.round("dispersion", 4).alias("dispersion"))


@query("select label, case when count(distinct vec_id % 2) = 1 then max(vec_id % 2) end as parity, case when count(distinct label) = 1 then max(label) end as same from embeddings group by label")
def unanimous_value(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(D.unanimous(F.col("vec_id") % 2).alias("parity"), D.unanimous("label").alias("same"))


@query("""with e as (select vec_id, label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as m from e group by all),
s as (select vec_id, ['mfcc', 'logMel', 'pitch', 'spectral'][((i - 1) // 16)::int + 1] as family, sum(pow(x - m, 2)) as sd from e join m using (label, i) group by all)
select vec_id, family, round(sd, 6) as squared_distance, round(case when sum(sd) over (partition by vec_id) > 1e-12 then sd / sum(sd) over (partition by vec_id) else 0 end, 6) as fraction from s""")
def feature_contribution(spark, sf_dir):
    e, centers = _centers(spark, sf_dir)
    families = F.array(*[F.struct(F.lit("raw").alias("view"), F.lit(f).alias("family"), F.lit(1.0).alias("weight")) for f in ("mfcc", "logMel", "pitch", "spectral") for _ in range(16)])
    rows = e.join(centers.withColumnRenamed("c", "label"), "label").withColumn("k", families)
    return rounded(G.feature_contributions(rows, ["vec_id"], "embedding", "center", "k").select("vec_id", "family", "squared_distance", "fraction"), "squared_distance", "fraction")


FAMILY_COUNTS = {"mfcc": 5, "logMel": 4, "pitch": 2, "spectral": 3, "dynamics": 2, "consistency": 3, "quality": 1}


@query("""with w(family, weight, n) as (values ('mfcc', 1.0, 5), ('logMel', 0.75, 4), ('pitch', 0.65, 2), ('spectral', 0.45, 3), ('dynamics', 0.15, 2), ('consistency', 0.35, 3), ('quality', 0.25, 1))
select label, view, family, n as n_coordinates, round(case when view = 'enhanced' then 0.45 else 1.0 end * weight, 6)::double as weight from (select distinct label from embeddings), w, (values ('raw'), ('enhanced')) v(view)""")
def family_weighting(spark, sf_dir):
    coordinates = F.array(*[F.struct(F.lit(v).alias("view"), F.lit(f).alias("family"), F.lit(1.0).alias("weight")) for v in ("raw", "enhanced") for f, n in FAMILY_COUNTS.items() for _ in range(n)])
    rows = table(spark, sf_dir, "embeddings").select("label").distinct().withColumn("coordinates", coordinates)
    fresh = rows.withColumn("coordinates", O.reweighted("coordinates", O.weight_settings(FeatureWeights(), "normalizedFamily")))
    counted = O.family_counts(fresh, ["label"])
    return rounded(counted.withColumn("n_coordinates", F.col("n_coordinates").cast("int")), "weight")


# --- clustering, smoothing, replays --------------------------------------------------


def _vector_sessions(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % 10).alias("session_id"), F.col("vec_id").alias("obs_id"), F.col("embedding").alias("v"), (0.2 + (F.col("vec_id") % 5) / 6).alias("w"), (F.col("vec_id") * 0.05).alias("start_s"), (F.col("vec_id") * 0.05 + 0.4).alias("end_s"))


@query(IS.FIXED_SQL)
def kmeans_fixed_k(spark, sf_dir):
    c = C.cluster_sessions(_vector_sessions(spark, sf_dir), KEYS, "v", "w", config=DiarizationConfig(expected_speakers=4))
    return rounded(c.select(*KEYS, "obs_id", "cluster", "cost", "confidence"), "cost", "confidence")


@query(IS.AUTO_SQL)
def auto_k(spark, sf_dir):
    c = C.cluster_sessions(_vector_sessions(spark, sf_dir), KEYS, "v", "w", config=DiarizationConfig(maximum_speakers=6, minimum_improvement=0.02), metric=C.COSINE)
    return c.groupBy(*KEYS).agg(F.first("n_clusters").alias("n_clusters"), F.round(F.first("cost"), 6).alias("cost"))


@query(IS.VITERBI_SQL)
def viterbi(spark, sf_dir):
    rows = _vector_sessions(spark, sf_dir)
    c = C.cluster_sessions(rows, KEYS, "v", "w", config=DiarizationConfig(expected_speakers=3))
    names = F.array(*[F.lit(f"speaker_{i + 1}") for i in range(3)])
    named = rows.join(c, [*KEYS, "obs_id"]).select(*KEYS, "obs_id", "start_s", "end_s", names.alias("speakers"), "costs", F.concat(F.lit("speaker_"), (F.col("cluster") + 1).cast("string")).alias("speaker"), "confidence", F.col("w").alias("reliability"))
    s = H.smooth_sessions(named, KEYS, CoherenceConfig())
    return s.select(*KEYS, "obs_id", "speaker", "resolved_speaker", "changed_by_continuity", F.round("resolved_confidence", 6).alias("resolved_confidence"), F.round("transition.cost", 6).alias("transition_cost"))


@query(IS.GREEDY_SQL)
def greedy_label_match(spark, sf_dir):
    rows = _vector_sessions(spark, sf_dir).withColumn("baseline", F.concat(F.lit("speaker_"), (F.col("obs_id") % 3 + 1).cast("string")))
    c = C.cluster_sessions(rows, KEYS, "v", "w", config=DiarizationConfig(expected_speakers=4))

    def run(g):
        g = g.sort_values("obs_id")
        k = int(g["cluster"].max()) + 1
        names = C.match_labels(g["cluster"].to_numpy(), k, g["baseline"].tolist())
        out = g[["session_id"]].head(1).merge(g.__class__({"cluster": list(range(k)), "speaker": names}), how="cross")
        return out

    return rows.join(c, [*KEYS, "obs_id"]).select(*KEYS, "obs_id", "cluster", "baseline").groupBy(*KEYS).applyInPandas(run, "session_id long, cluster int, speaker string")


SIGNALS = {"tone_180": lambda: SG.sine(180, 0.5), "tone_420": lambda: SG.sine(420, 0.6), "quiet": lambda: SG.silence(0.25), "rough": lambda: SG.alternating(0.25), "harmonic": lambda: SG.sine(220, 0.6, 0.12) + SG.sine(440, 0.6, 0.24), "two_speakers": lambda: np.concatenate([x for _ in range(2) for x in (SG.sine(140, 0.8), SG.silence(0.2), SG.sine(270, 0.8), SG.silence(0.2))][:-1])}
SPOKEN = DiarizationConfig(grouping=GroupingConfig(0.25, 1.0, 0.08))


def _signal_frames(spark) -> DataFrame:
    from .streaming.frames import one_shot

    return one_shot(dsp.frames(SG.chunk_table(spark, {k: f() for k, f in SIGNALS.items()})))


@query()
def dsp_sine(spark, sf_dir):
    f = _signal_frames(spark)
    return f.groupBy("session_id", "activity").agg(F.count("*").alias("n_frames"), F.round(F.percentile("pitch_hz", F.lit(0.5)), 2).alias("median_pitch"), F.round(F.avg("consistency"), 4).alias("consistency"))


@query()
def diarized_signals(spark, sf_dir):
    r = P.diarize(_signal_frames(spark), SPOKEN)
    return rounded(r.segments.drop("observation_ids"), "start_s", "end_s", "confidence")


@query()
def leave_one_out(spark, sf_dir):
    r = P.diarize(_signal_frames(spark), SPOKEN)
    out = P.leave_one_out(r).select("session_id", "ablation", "clustering_changes", "resolved_changes", "n_speakers", "n_segments", "normalized_cost")
    return rounded(out, "normalized_cost")


@query()
def trace_csv(spark, sf_dir):
    return E.trace_csv(P.diarize(_signal_frames(spark), SPOKEN))


@query()
def context_json(spark, sf_dir):
    r = P.diarize(_signal_frames(spark), SPOKEN)
    spoken = r.segments.select("session_id", F.col("segment_index").alias("utterance"), F.col("start_s"), F.col("end_s"))
    told = A.attributed(spoken.withColumns({"text": F.lit("words"), "confidence": F.lit(None).cast("double"), "alternatives": F.expr("cast(array() as array<string>)"), "is_final": F.lit(True)}), A.aligned(spoken, r.segments, KEYS), KEYS)
    return CX.context_json(CX.context(r, told, "diagnostic"))


# --- frames of samples that follow the tables ------------------------------------------------------


def _event_chunks(spark, sf_dir) -> DataFrame:
    """A recording of 1024 samples for every user of the events: two tones and a rough part."""
    users = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("u")).agg(F.count("*").alias("n"))
    tone = lambda f, i: F.sin(2 * np.pi * f * i / 16000)
    x = lambda i: ((0.05 + 0.001 * (F.col("n") % 100)) * tone(100 + F.col("u") % 300, i) + 0.05 * tone(900 + F.col("u") % 700, i) + ((i * 37 + i * i * 13) % 101 - 50) / F.lit(500.0)).cast("float")
    return users.select(F.col("u").cast("string").alias("session_id"), F.lit(0).cast("long").alias("chunk_index"), F.lit(0.0).alias("start_s"), F.lit(16000).alias("sample_rate"), F.transform(F.sequence(F.lit(0), F.lit(1023)), x).alias("samples"))


@query(IS.SPECTRA_SQL)
def frame_spectra(spark, sf_dir):
    """Level, spectrum, pitch, mel energies and cepstrum of every frame; the SQL is a plain Fourier sum."""
    f = dsp.frames(_event_chunks(spark, sf_dir))
    cells = [F.element_at("log_mel", i).alias(f"mel_{i}") for i in (1, 12, 24)] + [F.element_at("mfcc", i + 1).alias(f"mfcc_{i}") for i in (0, 1, 12)]
    out = f.select(F.col("session_id").cast("long").alias("session_id"), F.round("start_s", 3).alias("start_s"), "rms", "peak", "zcr", "clip", "centroid_hz", "spread_hz", "rolloff_hz", "flatness", "pitch_hz", "pitch_conf", "voiced_prob", *cells)
    out = rounded(out, "rms", "peak", "zcr", "clip", "flatness", "pitch_conf", "voiced_prob", places=5)
    return rounded(rounded(out, "centroid_hz", "spread_hz", "pitch_hz", places=3), "mel_1", "mel_12", "mel_24", "mfcc_0", "mfcc_1", "mfcc_12", places=4)


@query(f"select session_id, start_s, rms, centroid_hz, flatness, mel_12 from ({IS.SPECTRA_SQL})")
def streamed_frames(spark, sf_dir):
    """The same recordings in chunks of 200 samples, as a stream whose state carries the overlap of frames."""
    chunks = _event_chunks(spark, sf_dir).select("session_id", "sample_rate", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("c"), "samples")
    chunks = chunks.select("session_id", F.col("c").cast("long").alias("chunk_index"), (F.col("c") * 200 / F.lit(16000.0)).alias("start_s"), "sample_rate", F.slice("samples", F.col("c") * 200 + 1, F.lit(200)).alias("samples"), (F.col("c") == 5).alias("is_last"))
    f = SF.streamed_frames(chunks).select(F.col("session_id").cast("long").alias("session_id"), F.round("start_s", 3).alias("start_s"), F.round("rms", 5).alias("rms"), F.round("centroid_hz", 3).alias("centroid_hz"), F.round("flatness", 5).alias("flatness"), F.round(F.element_at("log_mel", 12), 4).alias("mel_12"))
    return f


@query("""select user_id as session_id, count(*) * 2 as n_samples, round(min_by(value / 100, event_id), 6) as start_s, round(sum((value / 100)::float::double + (event_id % 7)::float::double), 3) as total, round(max_by((value / 100)::float::double, event_id), 6) as last from events group by user_id""")
def session_buffers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("chunk_index"), (F.col("value") / 100).alias("start_s"), F.lit(16000).alias("sample_rate"), F.array(F.col("event_id") % 7, F.col("value") / 100).cast("array<float>").alias("samples"))
    b = SG.session_buffers(c)
    return b.select("session_id", F.size("samples").cast("long").alias("n_samples"), F.round("start_s", 6).alias("start_s"), F.round(V.total(F.col("samples").cast("array<double>")), 3).alias("total"), F.round(F.element_at("samples", -1).cast("double"), 6).alias("last"))


USABLE_SQL = GROUPS_SQL.replace("from f)", "from u where usable)")


@query(f"""with recursive {EVENT_FRAMES_SQL}, {FLOORS_SQL}, {USABLE_SQL},
g as (select session_id, group_no, min(start_s) as s, max(end_s) as e, count(*) as n, min(id) as first_id, max(id) as last_id from walk group by all having max(end_s) - min(start_s) >= 0.25)
select session_id, row_number() over (partition by session_id order by group_no) - 1 as obs_id, round(s, 6) as start_s, round(e, 6) as end_s, n as n_frames, first_id, last_id from g""")
def usable_groups(spark, sf_dir):
    usable = FR.classified(event_frames(spark, sf_dir), KEYS, ACOUSTIC).where("usable")
    o, _ = O.grouped_frames(usable, KEYS, GROUPING)
    return rounded(o.select(*KEYS, "obs_id", "start_s", "end_s", F.size("frame_ids").cast("long").alias("n_frames"), F.element_at("frame_ids", 1).alias("first_id"), F.element_at("frame_ids", -1).alias("last_id")), "start_s", "end_s")


@query(f"""with {EVENT_FRAMES_SQL}, g as (select session_id, id // 20 as obs_id, f.* exclude (session_id), 0.5 + k / 250 as consistency, k / 300 as transient, 1 - k / 100 as quality_score from f),
s as (select session_id, obs_id, [avg(mfcc[1]), avg(mfcc[2]), stddev_pop(mfcc[1]), stddev_pop(mfcc[2]), avg(log_mel[1]), avg(log_mel[2]),
  case when quantile_cont(pitch_hz, 0.5) > 0 then log2(quantile_cont(pitch_hz, 0.5) / 100) else 0 end, coalesce(stddev_pop(pitch_hz), 0) / 200,
  avg(centroid_hz) / 4, avg(spread_hz) / 4, 0, avg(flatness) / 4, avg(rms), avg(zcr), avg(consistency), avg(transient), avg(quality_score)] as v from g group by all)
select session_id, obs_id, i - 1 as place, round(v[i], 9) as value from (select *, unnest(range(1, 18)) as i from s)""")
def observation_vector(spark, sf_dir):
    f = event_frames(spark, sf_dir).withColumns({"obs_id": F.floor(F.col("id") / 20), "consistency": 0.5 + F.col("k") / 250, "transient": F.col("k") / 300, "quality_score": 1 - F.col("k") / 100, "rolloff_hz": F.lit(0.0), "sample_rate": F.lit(4)})
    values, _ = O.feature_vector("families", "raw", FeatureWeights())
    v = O.view_features(f, KEYS).select(*KEYS, "obs_id", F.posexplode(values).alias("place", "value"))
    return rounded(v.withColumn("place", F.col("place").cast("long")), "value", places=9)


@query("""with p as (select a.vec_id, a.label, a.embedding::double[] as a, b.embedding::double[] as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
c as (select *, list_transform(a, lambda x: x - list_avg(a)) as ca, list_transform(b, lambda x: x - list_avg(b)) as cb from p),
r as (select label, (list_dot_product(a[2:], b[2:]) / sqrt(list_dot_product(a[2:], a[2:]) * list_dot_product(b[2:], b[2:])) + 1) / 2 as m, (list_dot_product(ca, cb) / sqrt(list_dot_product(ca, ca) * list_dot_product(cb, cb)) + 1) / 2 as l from c)
select label as obs_id, round(avg(m), 6) as mfcc_shape, round(avg(l), 6) as log_mel_shape, round((avg(m) + avg(l)) / 2, 6) as combined from r group by label""")
def view_agreement(spark, sf_dir):
    """A vector and the next one as two views of one frame."""
    e = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("session_id"), F.col("vec_id").alias("id"), F.col("label").alias("obs_id"), F.col("embedding").alias("mfcc"), F.col("embedding").alias("log_mel"))
    a = O.view_agreement(e, e.withColumn("id", F.col("id") - 1), KEYS)
    return rounded(a.select("obs_id", "agreement.*"), "mfcc_shape", "log_mel_shape", "combined")


@query("""select vec_id, round((embedding[1]::double / sqrt(list_dot_product(embedding::double[], embedding::double[])))::float::double, 5) as first, round(sqrt(list_avg(list_transform(embedding::double[], lambda x: x * x))), 6) as magnitude,
  round(embedding[1]::double * sqrt(greatest(0, vec_id % 5 - 1)) + embedding[2]::double, 6) as weighted, vec_id % 4 <> 0 as has_embedding from embeddings""")
def admitted_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    # Vectors of another length are not admitted.
    rows = e.unionByName(e.select((F.col("vec_id") + 10_000_000).alias("vec_id"), F.slice("embedding", 1, 5).alias("embedding"), "label"))
    unit = EM.admitted(rows, 64).select("vec_id", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"))
    w = V.sqrt_weighted("embedding", F.array((F.col("vec_id") % 5 - 1).cast("double"), F.lit(None).cast("double")))
    kept = e.withColumn("values", F.col("embedding").cast("array<double>")).withColumn("x", w).withColumn("magnitude", F.round(V.rms_magnitude("embedding"), 6))
    kept = kept.withColumn("embedding", F.when(F.col("vec_id") % 4 != 0, F.col("embedding"))).withColumn("k", EM.clustering_evidence("hybrid"))
    return unit.join(kept, "vec_id").select("vec_id", "first", "magnitude", F.round(F.element_at("x", 1) + F.element_at("x", 2), 6).alias("weighted"), F.col("k").isNotNull().alias("has_embedding"))


@query("select event_type, round(coalesce(avg(case when value > 100000 then value end), 0), 6) as none, round(coalesce(avg(value), 0), 6) as mean, round(coalesce(stddev_pop(value), 0), 6) as deviation from events group by event_type")
def defaults_of_nothing(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rounded(e.groupBy("event_type").agg(D.mean_or_zero(F.when(F.col("value") > 100000, F.col("value"))).alias("none"), D.mean_or_zero("value").alias("mean"), D.deviation_or_zero("value").alias("deviation")), "none", "mean", "deviation")


# --- comparisons and sets --------------------------------------------------------------------------


@query("select doc_id, quality as baseline, toxic as replay from labels where quality <> toxic")
def replay_compare(spark, sf_dir):
    l = table(spark, sf_dir, "labels").withColumn("session_id", F.lit(0)).select("session_id", F.col("doc_id").alias("obs_id"), F.lit(0.0).alias("start_s"), F.lit(0.0).alias("end_s"), "quality", "toxic")
    c = G.compared(l.withColumnRenamed("quality", "label"), l.withColumnRenamed("toxic", "label"), KEYS, "label")
    return c.select(F.col("obs_id").alias("doc_id"), F.col("baseline_speaker").alias("baseline"), F.col("replay_speaker").alias("replay"))


@query("select count(*) as n_difference from (select doc_id from labels where quality = 1 except select doc_id from labels where toxic = 1)")
def set_recovered(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    return joins.set_difference_count(l.where("quality = 1"), l.where("toxic = 1"), ["doc_id"])


@query("select user_id, event_type as speaker from events where value > 100 union select user_id, event_type from events where value < 5")
def set_union_speakers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("speaker"), "value")
    return joins.distinct_union(e.where("value > 100").drop("value"), e.where("value < 5").drop("value"))


@query("select conv_id, list_sort(list(distinct role)) = list_sort(list(distinct case when turn < 2 then role else 'user' end)) as same from conversations group by conv_id")
def set_equality(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return joins.same_sets(c, ["conv_id"], F.col("role"), F.when(F.col("turn") < 2, F.col("role")).otherwise("user"))


# --- interval and as-of joins ----------------------------------------------------------------------

OVERLAP_SQL = f"with {EVENT_FRAMES_SQL}, {TURNS_SQL}, ov as (select utt.session_id, utterance, segment_index, speaker, conf, least(u_end, s_end) - greatest(u_start, s_start) as overlap from utt join seg on utt.session_id = seg.session_id and s_start < u_end and u_start < s_end)"


def _spoken(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    f = event_frames(spark, sf_dir)
    return event_utterances(f), event_turns(f)


@query(f"{OVERLAP_SQL} select utterance, segment_index, round(overlap, 6) as overlap_s from ov where overlap > 0")
def overlap_join(spark, sf_dir):
    u, s = _spoken(spark, sf_dir)
    met = joins.overlap_join(A._utterances(u, KEYS), A._segments(s, KEYS), KEYS, ("u_start", "u_end"), ("s_start", "s_end"), 3.0)
    return rounded(met.select("utterance", F.col("s_index").alias("segment_index"), "overlap_s"), "overlap_s")


DIRECT_SQL = """sup as (select session_id, utterance, speaker, sum(overlap) as support, sum(conf * overlap) / sum(case when conf is not null then overlap end) as sure, list(segment_index order by segment_index) as segs from ov where overlap > 0 group by all),
dir as (select session_id, utterance, speaker, least(1, greatest(0, coalesce(sure, 0.5) * support / greatest(sum(support) over (partition by session_id, utterance), 1e-12))) as confidence, segs, row_number() over (partition by session_id, utterance order by support desc, speaker) as r from sup qualify r = 1)"""


@query(f"{OVERLAP_SQL}, {DIRECT_SQL} select utterance, speaker, round(confidence, 6) as confidence, array_to_string(segs, ',') as segments from dir")
def overlap_assignment(spark, sf_dir):
    u, s = _spoken(spark, sf_dir)
    return _said(A.overlapping(u, s, KEYS, 3.0))


def _said(df: DataFrame, *more: str) -> DataFrame:
    return rounded(df.select("utterance", "speaker", "confidence", *more, F.array_join(F.transform("segments", lambda x: x.cast("string")), ",").alias("segments")), "confidence")


AROUND_SQL = """bef as (select session_id, utterance, arg_max({'i': segment_index, 'sp': speaker, 'e': s_end, 'c': conf}, {'e': s_end, 'i': -segment_index}) as b from utt join seg using (session_id) where s_end <= u_start group by all),
aft as (select session_id, utterance, arg_min({'i': segment_index, 'sp': speaker, 's': s_start, 'c': conf}, {'s': s_start, 'i': segment_index}) as a from utt join seg using (session_id) where s_start >= u_end group by all),
around as (select utt.*, b, a from utt left join bef using (session_id, utterance) left join aft using (session_id, utterance)),
bri as (select session_id, utterance, b.sp as speaker, least(1, greatest(0, least(coalesce(b.c, 0.5), coalesce(a.c, 0.5)) * (1 - 0.5 * (a.s - b.e) / 24.0))) as confidence, [b.i, a.i] as segs from around where b.sp = a.sp and a.s - b.e between 0 and 24.0),
near0 as (select *, b is not null and greatest(0, u_start - b.e) <= 3.0 as l, a is not null and greatest(0, a.s - u_end) <= 3.0 as r from around),
near1 as (select session_id, utterance, case when l then b.sp else a.sp end as speaker, case when l then b.i else a.i end as i, case when l then b.c else a.c end as c, case when l then greatest(0, u_start - b.e) else greatest(0, a.s - u_end) end as d from near0 where l <> r),
nea as (select session_id, utterance, speaker, least(1, greatest(0, coalesce(c, 0.5) * (0.5 + 0.5 * (1 - d / 3.0)) * 0.75)) as confidence, [i] as segs from near1)"""


@query(f"with {EVENT_FRAMES_SQL}, {TURNS_SQL}, {AROUND_SQL} select utterance, b.i as before_index, a.i as after_index from around")
def nearest_before_after(spark, sf_dir):
    u, s = _spoken(spark, sf_dir)
    return A.with_neighbours(u, s, KEYS).select("utterance", F.col("before.s_index").alias("before_index"), F.col("after.s_index").alias("after_index"))


@query(f"with {EVENT_FRAMES_SQL}, {TURNS_SQL}, {AROUND_SQL} select utterance, speaker, round(confidence, 6) as confidence, array_to_string(segs, ',') as segments from bri where confidence >= 0.10")
def bridge(spark, sf_dir):
    u, s = _spoken(spark, sf_dir)
    return _said(A.bridged(A.with_neighbours(u, s, KEYS), KEYS, ALIGNMENT))


@query(f"with {EVENT_FRAMES_SQL}, {TURNS_SQL}, {AROUND_SQL} select utterance, speaker, round(confidence, 6) as confidence, array_to_string(segs, ',') as segments from nea where confidence >= 0.10")
def nearest(spark, sf_dir):
    u, s = _spoken(spark, sf_dir)
    return _said(A.nearest(A.with_neighbours(u, s, KEYS), KEYS, ALIGNMENT))


CASCADE_SQL = f"""{OVERLAP_SQL}, {DIRECT_SQL}, {AROUND_SQL}, ways as (select 0 as o, 'temporalOverlap' as method, session_id, utterance, speaker, confidence, segs from dir
  union all select 1, 'bridgedGap', session_id, utterance, speaker, confidence, segs from bri where confidence >= 0.10 union all select 2, 'nearestEvidence', session_id, utterance, speaker, confidence, segs from nea where confidence >= 0.10),
ali as (select * from ways qualify row_number() over (partition by session_id, utterance order by o) = 1)"""


@query(f"{CASCADE_SQL} select utterance, speaker, round(confidence, 6) as confidence, method, array_to_string(segs, ',') as segments from ali")
def align_cascade(spark, sf_dir):
    u, s = _spoken(spark, sf_dir)
    return _said(A.aligned(u, s, KEYS, ALIGNMENT, 3.0), "method")


@query(f"{CASCADE_SQL} select utterance, speaker from ali where method = 'bridgedGap'")
def alignments_by_method(spark, sf_dir):
    u, s = _spoken(spark, sf_dir)
    return A.by_method(A.aligned(u, s, KEYS, ALIGNMENT, 3.0), "bridgedGap").select("utterance", "speaker")


@query(f"""{CASCADE_SQL} select utterance, '[' || printf('%.2f', u_start) || ' ... ' || printf('%.2f', u_end) || '] ' || coalesce(speaker, 'unassigned') || coalesce(' ' || printf('%.2f', round(confidence, 6)), '') || '  ' || 'event ' || utterance as line from utt left join ali using (session_id, utterance)""")
def attributed_lines(spark, sf_dir):
    u, s = _spoken(spark, sf_dir)
    a = rounded(A.aligned(u, s, KEYS, ALIGNMENT, 3.0), "confidence")
    t = A.attributed(u.withColumn("text", F.concat(F.lit("event "), F.col("utterance").cast("string"))), a, KEYS)
    return t.select("utterance", CX.attributed_line().alias("line"))


@query(f"""with {EVENT_FRAMES_SQL}, fr as (select * from f where event_type = 'view'), bl as (select session_id, start_s as bs, start_s + 8.0 as be, value as gain from f where event_type = 'click')
select fr.id, case when fr.start_s < be then round(gain, 6) end as gain from fr asof left join bl on fr.session_id = bl.session_id and fr.start_s >= bl.bs""")
def asof_gain(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    blocks = f.where("event_type = 'click'").select(*KEYS, F.col("start_s").alias("bs"), (F.col("start_s") + 8.0).alias("be"), F.col("value").alias("g"))
    found = joins.covering_block(f.where("event_type = 'view'").select(*KEYS, "id", "start_s"), blocks, KEYS, "start_s", ("bs", "be"), "g", "gain")
    return rounded(found.select("id", "gain"), "gain")


@query("""with o as (select o_custkey as session_id, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as obs_id, o_totalprice from orders), l as (select l_orderkey, l_linenumber, l_extendedprice from lineitem)
select session_id, obs_id, count(l_linenumber) as n_rows, round(sum(l_extendedprice), 2) as total from o join l on l_orderkey = o_orderkey group by all""")
def join_through_ids(spark, sf_dir):
    o = R.rebased(table(spark, sf_dir, "orders").withColumn("session_id", F.col("o_custkey")), KEYS, ["o_orderkey"], "obs_id").select(*KEYS, (F.col("obs_id") + 1).alias("obs_id"), F.array("o_orderkey").alias("ids"))
    lines = o.select(*KEYS, F.explode("ids").alias("l_orderkey")).join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey")
    met = joins.through_ids(o, "ids", lines, KEYS, "l_orderkey")
    return met.groupBy(*KEYS, "obs_id").agg(F.count("l_linenumber").alias("n_rows"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("select vec_id, case when label < 4 then 'new' when vec_id % 2 = 0 then 'old' else 'none' end as kind from embeddings")
def embedding_enrichment(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    one = lambda x: F.array(F.lit(x)).cast("array<float>")
    obs = e.select("vec_id", F.when(F.col("vec_id") % 2 == 0, one(1.0)).alias("embedding"))
    out = EM.enriched(obs, e.where("label < 4").select("vec_id", one(2.0).alias("embedding")), ["vec_id"])
    return out.select("vec_id", F.when(F.element_at("embedding", 1) == 2.0, "new").when(F.element_at("embedding", 1) == 1.0, "old").otherwise("none").alias("kind"))


@query(f"""with {EVENT_FRAMES_SQL}, r as (select id, greatest(0, value / 10 - 10) as lo, least(6.25, value / 10 + k / 100 - 10) as hi from f),
b as (select id, greatest(0, least(100000, floor(lo * 16000))) as first, hi > lo as ok, greatest(greatest(0, least(100000, floor(lo * 16000))), least(100000, ceil(hi * 16000))) as past, hi from r)
select id, case when ok and past > first then first::bigint end as first, case when ok and past > first then past::bigint end as past from b""")
def window_samples(spark, sf_dir):
    f = event_frames(spark, sf_dir).select("id", (F.col("value") / 10).alias("s"), (F.col("value") / 10 + F.col("k") / 100).alias("e"), F.lit(10.0).alias("a"), F.lit(16000).alias("r"), F.lit(100000).alias("n"))
    x = f.select("id", SG.sample_range("s", "e", "a", "r", "n").alias("x"))
    return x.select("id", "x.first", "x.past")


@query(f"""with {EVENT_FRAMES_SQL}, c as (select session_id, id, case when id % 4 = 0 then start_s end as known, (100 + k) / 10.0 as len, row_number() over (partition by session_id order by id) as rn from f),
b as (select *, coalesce(sum(len) over (partition by session_id order by id rows between unbounded preceding and 1 preceding), 0) as before from c),
g as (select *, last_value(known ignore nulls) over w as since, last_value(case when known is not null then before end ignore nulls) over w as anchor from b window w as (partition by session_id order by id rows between unbounded preceding and current row))
select id, round(coalesce(since, 0) + before - coalesce(anchor, 0), 6) as start_s from g""")
def chunk_starts(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    c = f.select(*KEYS, "id", F.when(F.col("id") % 8 == 0, F.col("start_s")).alias("range_start_s"), F.when(F.col("id") % 4 == 0, F.col("start_s")).alias("presentation_s"), F.lit(None).cast("double").alias("host_s"), (100 + F.col("k")).alias("n_samples"), F.lit(10).alias("sample_rate"))
    return rounded(SG.resolved_starts(c, KEYS, "id").select("id", "start_s"), "start_s")


# --- text ------------------------------------------------------------------------------------------


@query("select conv_id, string_agg(text, '' order by turn) as text from conversations group by conv_id")
def transcript_concat(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(X.joined_in_order("text", "turn").alias("text"))


@query("""select doc_id, concat_ws(',', doc_id::varchar, case when contains(text, ',') or contains(text, '"') or contains(text, chr(10)) then '"' || replace(text, '"', '""') || '"' else text end, printf('%.8f', n_chars / 7.0), case when lang = 'en' then '1' else '0' end, '') as line from documents""")
def csv_trace(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumns({"x": F.col("n_chars") / F.lit(7.0), "en": F.col("lang") == "en", "none": F.lit(None).cast("double"), "id": F.col("doc_id").cast("string")})
    return d.select("doc_id", E.csv_line({"id": "text", "text": "text", "x": "number", "en": "flag", "none": "number"}).alias("line"))


@query(f"select user_id, count(*) as block_count, {DISTRIBUTION_SQL.format(c='value')} from events where event_type = 'click' group by user_id")
def enhancement_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", F.col("value").alias("gain_db"), F.lit(0.0).alias("input_rms_db"), F.lit(0.0).alias("output_rms_db"))
    return fields(CX.enhancement_summary(e, ["user_id"]).select("user_id", "block_count", "gain_db"), "gain_db")


@query(f"""with {EVENT_FRAMES_SQL}, x as (select event_type, id, rms, pitch_hz, quality, quality >= 0.55 as usable, log_mel from (select *, 1 - k / 100 as quality from f))
select event_type, round(avg(rms), 6) as rms_mean, count(pitch_hz) as n_pitched, round(coalesce(quantile_cont(pitch_hz, 0.5), 0), 6) as pitch_median, round(avg((not usable and id % 2 = 0)::int), 6) as recovered_fraction, round(avg(log_mel[1]), 6) as mel_1, round(stddev_pop(log_mel[1]), 6) as mel_spread_1 from x group by event_type""")
def acoustic_profile(spark, sf_dir):
    f = event_frames(spark, sf_dir).withColumn("all", F.lit(0)).withColumns({"quality_score": 1 - F.col("k") / 100, "consistency": F.lit(0.5)}).withColumn("usable", F.col("quality_score") >= 0.55)
    agreement = F.lit(None).cast("struct<mfcc_shape:double,log_mel_shape:double,combined:double>")
    owners = f.select("all", "event_type", F.array("id").alias("frame_ids"), agreement.alias("agreement"))
    enhanced = f.select("all", "id", F.lit(1.0).alias("quality_score"), (F.col("id") % 2 == 0).alias("usable"))
    p = G.acoustic_profiles(owners, f.drop("event_type"), ["all"], enhanced)
    out = p.select("event_type", F.col("rms.mean").alias("rms_mean"), F.col("pitch_hz.count").alias("n_pitched"), F.col("pitch_hz.median").alias("pitch_median"), "recovered_fraction", F.element_at("log_mel_mean", 1).alias("mel_1"), F.element_at("log_mel_dispersion", 1).alias("mel_spread_1"))
    return rounded(out, "rms_mean", "pitch_median", "recovered_fraction", "mel_1", "mel_spread_1")


@query("""with s as (select event_type as speaker, user_id as session_id, event_id as obs_id, value / 100 as dur, value > 200 as changed, 0.2 + value / 1000 as w, [value, ln(value + 1)] as v from events)
select session_id, speaker, count(*) as observation_count, round(sum(dur), 6) as observed_s, round(sum(v[1] * w) / sum(w), 6) as centroid_1, round(sum(v[2] * w) / sum(w), 6) as centroid_2 from s where not changed group by all""")
def speaker_profile(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("speaker"), F.lit(0.0).alias("start_s"), (F.col("value") / 100).alias("end_s"), (F.col("value") > 200).alias("changed_by_continuity"), (0.2 + F.col("value") / 1000).alias("reliability"), F.array("value", F.log(F.col("value") + 1)).alias("values"))
    p = G.speaker_profiles(e, KEYS)
    return rounded(p.select(*KEYS, "speaker", "observation_count", "observed_s", F.element_at("centroid", 1).alias("centroid_1"), F.element_at("centroid", 2).alias("centroid_2")), "observed_s", "centroid_1", "centroid_2")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
