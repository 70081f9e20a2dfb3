from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.config import ABLATION_TARGETS, DiarizationConfig, FeatureWeights, GroupingConfig, HybridWeights, half_away
from cadenza.functions import scalars as S
from cadenza.functions import vectors as V
from cadenza.functions.text import csv_field, decimals
from cadenza.operators import clustering as C
from cadenza.operators import joins
from cadenza.operators import ordered as R
from cadenza.operators import segments as G
from cadenza.sources import embeddings as EM


def test_settings():
    assert half_away(2.5) == 3 and half_away(-2.5) == -3
    w = HybridWeights(35, 65)
    assert (w.acoustic, w.embedding) == (0.35, 0.65)
    for bad in ((-1, 2), (0, 0), (math.inf, 1)):
        with pytest.raises(ValueError):
            HybridWeights(*bad)
    assert FeatureWeights().ablating("mfcc").mfcc == 0 and len(ABLATION_TARGETS) == 8
    with pytest.raises(ValueError):
        GroupingConfig(2, 1, 0)


def test_decimals_are_those_of_c(spark):
    xs = [0.205, 0.575, 0.125, -0.125, -0.001, 1.005, 2.675, 123456.785, 0.0, *np.round(np.random.default_rng(0).uniform(-50, 50, 500), 3).tolist()]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for places in (2, 3, 8):
        for r in df.select("x", decimals("x", places).alias("y")).collect():
            assert r["y"] == f"{r['x']:.{places}f}"


def test_csv_field(spark):
    df = spark.createDataFrame([("plain",), ("a,b",), ('say "hi"',), ("two\nlines",), (None,)], "t string")
    assert [r[0] for r in df.select(csv_field("t")).collect()] == ["plain", '"a,b"', '"say ""hi"""', '"two\nlines"', ""]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = df.select(V.l2_normalized("a").alias("u"), V.embedding_distance("a", "b").alias("d"), V.cosine_agreement("a", "b").alias("g"), V.rms_distance("a", "b").alias("r")).collect()
    assert got[0]["u"] == pytest.approx([0.6, 0.8]) and got[0]["d"] == pytest.approx(0.4)
    assert got[1]["u"] is None and got[1]["d"] is None and got[1]["g"] == 1
    assert got[2]["d"] is None and got[2]["g"] == 1 and got[2]["r"] == 0


def test_reliability_bounds(spark):
    df = spark.createDataFrame([(x / 20,) for x in range(21)] + [(None,)], "x double")
    got = [r[0] for r in df.select(S.reliability("x")).collect()]
    assert got[0] == 1 and got[20] == pytest.approx(0.2) and got[-1] == 1
    assert all(a >= b for a, b in zip(got, got[1:21], strict=False))


def naive_groups(rows, gap, span):
    out, first, last, n = [], None, None, 0
    for s, e in rows:
        if first is None:
            first = s
        elif s - last > gap or e - first > span:
            first, n = s, n + 1
        last = e
        out.append(n)
    return out


def test_capped_gap(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(6):
        starts = np.cumsum(rng.exponential(0.3, 400))
        ranges = [(float(s), float(s + d)) for s, d in zip(starts, rng.uniform(0.01, 0.3, 400), strict=True)]
        want[k] = naive_groups(ranges, 0.4, 1.5)
        rows += [(k, i, s, e) for i, (s, e) in enumerate(ranges)]
    df = spark.createDataFrame(rows, "session_id long, id long, start_s double, end_s double").repartition(7)
    got = R.capped_gap_groups(df, ["session_id"], "start_s", "end_s", ["id"], 0.4, 1.5)
    for k in range(6):
        assert [r["group_no"] for r in got.where(F.col("session_id") == k).orderBy("id").collect()] == want[k]
    assert R.capped_gap_groups(df.limit(0), ["session_id"], "start_s", "end_s", ["id"], 0.4, 1.5).count() == 0


def test_islands_and_spans(spark):
    rows = [("a", 0, 1.0, 1.4, "s1", "s2"), ("a", 1, 1.45, 1.85, "s1", "s2"), ("a", 2, 2.0, 2.4, "s2", "s1")]
    df = spark.createDataFrame(rows, "session_id string, obs_id long, start_s double, end_s double, b string, r string")
    spans = G.change_spans(df, ["session_id"], "b", "r", 0.10).orderBy("span").collect()
    assert [(s["baseline_speaker"], s["replay_speaker"], s["n_observations"]) for s in spans] == [("s1", "s2", 2), ("s2", "s1", 1)]


def test_overlap_join_against_brute_force(spark):
    rng = np.random.default_rng(2)
    make = lambda n, d: [(int(rng.integers(0, 3)), i, float(s), float(s + w)) for i, (s, w) in enumerate(zip(rng.uniform(0, 50, n), rng.exponential(d, n), strict=True))]
    a, b = make(120, 1.0), make(150, 4.0)
    left = spark.createDataFrame(a, "k int, x long, ls double, le double")
    right = spark.createDataFrame(b, "k int, y long, rs double, re double")
    for width in (0.7, 5.0, 1000.0):
        got = {(r["x"], r["y"]) for r in joins.overlap_join(left, right, ["k"], ("ls", "le"), ("rs", "re"), width).collect()}
        assert got == {(p[1], q[1]) for p in a for q in b if p[0] == q[0] and min(p[3], q[3]) > max(p[2], q[2])}


def test_asof_ties_and_misses(spark):
    left = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 0.5), ("a", 3, None), ("b", 4, 5.0)], "k string, x long, t double")
    right = spark.createDataFrame([("a", 1.0, 10), ("a", 5.0, 20), ("a", 5.0, 30)], "k string, u double, v long")
    got = {r["x"]: r["asof"]["v"] if r["asof"] else None for r in joins.asof_join(left, right, ["k"], "t", "u", ["v"], [-F.col("v")]).collect()}
    assert got == {1: 20, 2: None, 3: None, 4: None}
    ahead = {r["x"]: r["asof"]["v"] if r["asof"] else None for r in joins.asof_join(left, right, ["k"], "t", "u", ["v"], [-F.col("v")], backward=False).collect()}
    assert ahead[2] == 10 and ahead[1] == 20


def test_kmeans_and_matching():
    v = np.array([[1, 0], [0.99, 0.01], [0, 1], [0.01, 0.99]], float)
    found = C.cluster(v, np.ones(4), DiarizationConfig(expected_speakers=2), C.COSINE)
    assert found.labels[0] == found.labels[1] != found.labels[2] == found.labels[3]
    assert C.match_labels(found.labels, 2, ["b", "b", "a", None]) == [["b", "a"][k] if found.labels[0] == 0 else ["a", "b"][k] for k in range(2)]
    assert C.match_labels(np.array([0, 1, 2]), 3, ["x", "x", "x"])[1:] == ["speaker_1", "speaker_2"]
    one = C.choose_k(np.ones((5, 2)), np.ones(5), DiarizationConfig())
    assert len(one.centroids) == 1 and one.cost == 0
    costs, sure = C.scaled_costs(np.array([[1.0], [2.0]]))
    assert (costs == 0).all() and (sure == 1).all()


@given(st.lists(st.tuples(st.floats(-5, 5), st.floats(-5, 5)), min_size=2, max_size=30), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_kmeans_laws(points, k):
    v = np.array(points)
    a = C.k_means(v, np.ones(len(v)), k)
    assert a.cost >= 0 and a.labels.max() < len(a.centroids) <= k
    assert (C.distances(v, a.centroids, C.SQUARED).min(1) >= 0).all()


def test_equal_weights_seed_from_the_first_row():
    """The row between the others goes to whichever of them was the seed's own side."""
    v = np.array([[1.0, 0.0], [np.sqrt(0.5), np.sqrt(0.5)], [0.0, 1.0]])
    for metric in (C.COSINE, C.SQUARED):
        assert C.k_means(v, np.ones(3), 2, 1, metric).labels.tolist() == [0, 0, 1]
        assert C.k_means(v, np.array([1.0, 1.0, 2.0]), 2, 1, metric).labels.tolist()[0] == 1


def test_overlap_join_of_rows_of_all_lengths(spark):
    """Ranges from a tenth of a bucket to many thousands: the pairs of brute force, and few copies of a row."""
    import random

    r = random.Random(2)
    make = lambda n: [(0, i, s := r.uniform(-50, 5000), s + r.choice([0.01, 0.3, 2, 60, 3000])) for i in range(n)]
    a, b = make(60), make(60)
    left, right = spark.createDataFrame(a, "g int, i int, s double, e double"), spark.createDataFrame(b, "g int, j int, t double, u double")
    got = sorted((x["i"], x["j"]) for x in joins.overlap_join(left, right, ["g"], ("s", "e"), ("t", "u"), 0.1).collect())
    assert got == sorted((i, j) for _, i, s, e in a for _, j, t, u in b if min(e, u) > max(s, t))
    assert joins._dealt(left, "s", "e", 0.1, "l").groupBy("i").count().agg({"count": "max"}).first()[0] <= 270


def test_too_large_a_model(spark, monkeypatch):
    monkeypatch.setattr(C, "MODEL", 3)
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "i int, v array<double>")
    with pytest.raises(ValueError):
        C.nearest_centroid(df, df, "v", "v", "i")


def test_missing_embedding_gives_no_clusters(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, None), ("b", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0])], "session_id string, obs_id long, v array<double>")
    got = {(r["session_id"], r["obs_id"]): r["cluster"] for r in C.cluster_sessions(df, ["session_id"], "v", config=DiarizationConfig(expected_speakers=2), metric=C.COSINE).collect()}
    assert got["a", 0] is None and got["b", 0] != got["b", 1]


def test_provider(spark):
    windows = spark.createDataFrame([("a", 0, [0.5] * 4, 16000), ("a", 1, [0.0] * 2, 16000)], "session_id string, obs_id long, samples array<float>, sample_rate int")
    got = EM.provided(windows, lambda x, rate: [3.0, 4.0] if len(x) == 4 else None)
    assert [r["obs_id"] for r in got.collect()] == [0]
    assert EM.admitted(got, 2).first()["embedding"] == pytest.approx([0.6, 0.8])
    assert EM.admitted(got).count() == 0
