"""From frames to speakers, turns and profiles, for any number of sessions at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ABLATION_TARGETS, DiarizationConfig, FeatureWeights, HybridWeights
from ..operators import clustering as C
from ..operators import coherence as H
from ..operators import frames as FR
from ..operators import observations as O
from ..operators import segments as S
from ..session import retained

KEYS = ("session_id",)
REPRESENTATIONS = ("acoustic", "embedding", "hybrid")


@dataclass(frozen=True)
class Result:
    """The tables of a run. ``observations`` and ``assignments`` have one row per observation."""

    observations: DataFrame
    assignments: DataFrame
    segments: DataFrame
    profiles: DataFrame
    evaluation: DataFrame
    config: DiarizationConfig
    representation: str = "acoustic"
    hybrid: HybridWeights | None = None
    frames: DataFrame | None = None
    enhanced: DataFrame | None = None
    noise: DataFrame | None = None
    evidence: DataFrame | None = None

    def speakers(self, keys: Sequence[str] = KEYS) -> DataFrame:
        """All speakers that have a turn or a profile."""
        return self.segments.select(*keys, "speaker").unionByName(self.profiles.select(*keys, "speaker")).distinct()


CANDIDATES = T.ArrayType(T.StructType([T.StructField("speaker", T.StringType()), T.StructField("cost", T.DoubleType()), T.StructField("distance", T.DoubleType())]))

ASSIGNMENT = [
    T.StructField("obs_id", T.LongType()),
    T.StructField("start_s", T.DoubleType()),
    T.StructField("end_s", T.DoubleType()),
    T.StructField("representation", T.StringType()),
    T.StructField("speaker", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("reliability", T.DoubleType()),
    T.StructField("candidates", CANDIDATES),
    T.StructField("n_speakers", T.IntegerType()),
    T.StructField("total_cost", T.DoubleType()),
    T.StructField("effective_weight", T.DoubleType()),
    T.StructField("total_reliability", T.DoubleType()),
    T.StructField("centroid", T.ArrayType(T.DoubleType())),
    T.StructField("vector", T.ArrayType(T.DoubleType())),
    *H.RESOLVED,
]


def _assigned(rows: pd.DataFrame, kind: str, names: list[str], picked: np.ndarray, sure: np.ndarray, costs: np.ndarray, far: np.ndarray, config: DiarizationConfig, total: float, weight: float | None, vectors: np.ndarray | None, centroids: np.ndarray | None) -> pd.DataFrame:
    reliability = rows["reliability"].to_numpy(float)
    chosen = [names[i] for i in picked.tolist()]
    resolved, moves = H.smooth(rows["start_s"].tolist(), rows["end_s"].tolist(), [names] * len(rows), costs.tolist(), chosen, sure, reliability, config.coherence)
    candidates = [[{"speaker": s, "cost": max(0.0, float(c)), "distance": max(0.0, float(d))} for s, c, d in zip(names, cs, ds, strict=True)] for cs, ds in zip(costs, far, strict=True)]
    out = pd.DataFrame({"obs_id": rows["obs_id"], "start_s": rows["start_s"], "end_s": rows["end_s"], "representation": kind, "speaker": chosen, "confidence": np.clip(sure, 0, 1), "reliability": reliability, "candidates": candidates, "n_speakers": len(names), "total_cost": total, "effective_weight": weight, "total_reliability": float(reliability.sum())})
    out["centroid"] = None if centroids is None else [c for c in centroids[picked]]
    out["vector"] = None if vectors is None else [v for v in vectors]
    return out.assign(**H.resolved_columns(chosen, resolved, sure, reliability, moves))


def acoustic_assignment(rows: pd.DataFrame, config: DiarizationConfig) -> pd.DataFrame:
    """One session: standardize by reliability, weigh, cluster, smooth."""
    dims = min(len(v) for v in rows["values"])
    C.check_size(len(rows), dims)
    reliability = rows["reliability"].to_numpy(float)
    raw = np.array([np.asarray(v, float)[:dims] for v in rows["values"]])
    total = reliability.sum()
    deviations = np.zeros(dims)
    vectors = raw
    if dims and total > 1e-12:
        means = (raw * reliability[:, None]).sum(0) / total
        deviations = np.sqrt((reliability[:, None] * (raw - means) ** 2).sum(0) / total)
        vectors = np.where(deviations > 1e-9, (raw - means) / np.where(deviations > 1e-9, deviations, 1.0), 0.0)
    weights = np.array([(list(w) + [1.0] * dims)[:dims] for w in rows["weights"]], float)
    vectors = vectors * np.sqrt(np.maximum(0, weights))
    found = C.cluster(vectors, reliability, config)
    d = C.distances(vectors, found.centroids, C.SQUARED)
    costs, sure = C.scaled_costs(d)
    names = [f"speaker_{i + 1}" for i in range(len(found.centroids))]
    effective = float(weights[0][deviations > 1e-9].sum())
    return _assigned(rows, "acoustic", names, found.labels, sure, costs, d, config, found.cost, effective, vectors, found.centroids)


def embedding_assignment(rows: pd.DataFrame, config: DiarizationConfig, baseline: list[str | None]) -> pd.DataFrame | None:
    """One session: cluster unit embeddings, name clusters after the baseline's speakers, smooth. None if an embedding is missing."""
    if any(e is None or len(e) == 0 for e in rows["embedding"]) or len({len(e) for e in rows["embedding"]}) != 1:
        return None
    vectors, good = C.unit_rows(np.array([np.asarray(e, float) for e in rows["embedding"]]))
    if not good.all():
        return None
    C.check_size(*vectors.shape)
    found = C.cluster(vectors, rows["reliability"].to_numpy(float), config, C.COSINE)
    d = C.distances(vectors, found.centroids, C.COSINE)
    costs, sure = C.scaled_costs(d)
    names = C.match_labels(found.labels, len(found.centroids), baseline)
    return _assigned(rows, "embedding", names, found.labels, sure, costs, d, config, found.cost, None, vectors, found.centroids)


def hybrid_assignment(rows: pd.DataFrame, acoustic: pd.DataFrame, embedding: pd.DataFrame, weights: HybridWeights, config: DiarizationConfig) -> pd.DataFrame | None:
    """One session: fuse both kinds of candidate costs. None unless both know the same speakers."""
    names = [c["speaker"] for c in acoustic["candidates"].iloc[0]]
    by_name = [{c["speaker"]: c["cost"] for c in row} for row in embedding["candidates"]]
    if len(set(names)) != len(names) or any(set(r) != set(names) for r in by_name):
        return None
    a = np.array([[c["cost"] for c in row] for row in acoustic["candidates"]])
    e = np.array([[r[n] for n in names] for r in by_name])
    raw = weights.acoustic * a + weights.embedding * e
    costs, sure = C.scaled_costs(raw)
    if raw.shape[1] > 1:
        second = np.partition(raw, 1, axis=1)[:, 1]
        sure = np.where(second <= 1e-12, 0.0, sure)
    picked = raw.argmin(1)
    total = float((costs[np.arange(len(raw)), picked] * rows["reliability"].to_numpy(float)).sum())
    return _assigned(rows, "hybrid", names, picked, sure, costs, raw, config, total, None, None, None)


def assign(observations: DataFrame, config: DiarizationConfig = DiarizationConfig(), representation: str = "acoustic", hybrid: HybridWeights | None = None, baseline: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """ASSIGNMENT rows of all sessions.

    ``observations`` has obs_id, range, values, weights, reliability (and
    embedding). ``baseline`` (keys, obs_id, resolved_speaker, candidates) names
    the clusters of embeddings and lends the acoustic costs of a hybrid.
    Sessions for which a representation is not to be had have no rows.
    """
    if representation not in REPRESENTATIONS:
        raise ValueError(f"no such representation: {representation}")
    if representation == "hybrid" and hybrid is None:
        raise ValueError("a hybrid needs the weights of both kinds of evidence")
    schema = T.StructType([*[observations.schema[k] for k in keys], *ASSIGNMENT])
    columns = [*keys, "obs_id", "start_s", "end_s", "values", "weights", "reliability"]
    columns += ["embedding"] if representation != "acoustic" else []
    rows = observations.select(*columns)
    if representation != "acoustic":
        b = baseline.select(*keys, "obs_id", F.col("resolved_speaker").alias("_baseline"), F.col("candidates").alias("_candidates"))
        rows = rows.join(b, [*keys, "obs_id"], "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("obs_id", kind="stable").reset_index(drop=True)
        if representation == "acoustic":
            out = acoustic_assignment(rows, config)
        else:
            known = [x if isinstance(x, str) else None for x in rows["_baseline"]]
            out = embedding_assignment(rows, config, known)
            if out is not None and representation == "hybrid":
                out = None if any(c is None for c in rows["_candidates"]) else hybrid_assignment(rows, rows.rename(columns={"_candidates": "candidates"}), out, hybrid, config)
        if out is None:
            return pd.DataFrame(columns=[f.name for f in schema.fields])
        for i, k in enumerate(keys):
            out.insert(i, k, rows[k].iloc[0])
        return out[[f.name for f in schema.fields]]

    return rows.groupBy(*keys).applyInPandas(run, schema)


def evaluation(assignments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per session: observations, speakers, cost, and the cost per unit of reliability and feature weight (acoustic only)."""
    scale = F.first("total_reliability") * F.first("effective_weight")
    return assignments.groupBy(*keys).agg(F.count("*").alias("n_observations"), F.first("n_speakers").alias("n_speakers"), F.first("representation").alias("representation"), F.first("total_cost").alias("cost"), F.when(scale > 1e-12, F.first("total_cost") / scale).alias("normalized_cost"))


def _result(observations: DataFrame, assignments: DataFrame, config: DiarizationConfig, keys: Sequence[str], **rest) -> Result:
    # Retained evidence: turns, profiles, comparisons and replays all read this table.
    assignments = retained(assignments, "assignments")
    turns = S.turns(assignments, keys, merge_gap=config.merge_gap_seconds)
    own = assignments.select(*keys, "obs_id", "start_s", "end_s", "speaker", "changed_by_continuity", "reliability").join(observations.select(*keys, "obs_id", "values"), [*keys, "obs_id"])
    return Result(observations, assignments, turns, S.speaker_profiles(own, keys), evaluation(assignments, keys), config, **rest)


def diarize(frames: DataFrame, config: DiarizationConfig = DiarizationConfig(), enhanced: DataFrame | None = None, keys: Sequence[str] = KEYS, embeddings: DataFrame | None = None) -> Result:
    """Runs every stage on classified frames (id, range, features, consistency, quality), and the enhanced view if there is one.

    Frames, noise evidence, observations and assignments are written as they are made,
    so that replays and exports read them instead of running the stages again.
    """
    frames = retained(frames, "frames")
    enhanced = retained(enhanced, "frames") if enhanced is not None else None
    noise = FR.noise_profiles(frames, keys)
    evidence = retained(FR.noise_evidence(frames, noise, keys), "evidence") if enhanced is not None else None
    obs = O.observations(frames, keys, config.grouping, enhanced)
    if evidence is not None:
        obs = obs.join(FR.reliabilities(obs, evidence, keys, config.reliability), [*keys, "obs_id"])
    else:
        obs = obs.withColumns({"noise_likelihood": F.lit(None).cast("double"), "n_sources": F.lit(0).cast("long"), "taper": F.lit(0.0), "reliability": F.lit(1.0)})
    if embeddings is not None:
        from ..sources.embeddings import enriched

        obs = enriched(obs, embeddings, [*keys, "obs_id"])
    else:
        obs = obs.withColumn("embedding", F.lit(None).cast("array<float>"))
    obs = retained(obs, "observations")
    return _result(obs, assign(obs, config, keys=keys), config, keys, frames=frames, enhanced=enhanced, noise=noise, evidence=evidence)


def _reweighted(obs: DataFrame, settings) -> DataFrame:
    """Lays weights on the coordinates; observations without a coordinate for each value stay as they are."""
    fits = F.size("coordinates") == F.size("values")
    fresh = obs.withColumn("coordinates", F.when(fits, O.reweighted("coordinates", settings)).otherwise(F.col("coordinates")))
    return fresh.withColumn("weights", F.when(fits, F.transform("coordinates", lambda c: c["weight"])).otherwise(F.col("weights")))


def _variants(source: Result, variants: Sequence[tuple[str, FeatureWeights, str]], name: str, keys: Sequence[str]) -> DataFrame:
    """Comparisons of many acoustic replays at once: the variant is one more key, so all of them are one job."""
    listed = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(label).alias("label"), O.weight_settings(w, kind).alias("settings")) for i, (label, w, kind) in enumerate(variants)])
    obs = _reweighted(source.observations.withColumn("_v", F.explode(listed)), F.col("_v.settings"))
    more = [*keys, name, f"{name}_no"]
    obs = retained(obs.withColumns({name: F.col("_v.label"), f"{name}_no": F.col("_v.no")}).drop("_v"), "variants")
    rows = assign(obs, source.config, keys=more)
    other = _result(obs, rows, source.config, more)
    labels = other.observations.select(*more, "obs_id")
    baseline = replace(source, assignments=labels.join(source.assignments, [*keys, "obs_id"]))
    return comparison(baseline, other, more)


def replay(source: Result, config: DiarizationConfig | None = None, weights: FeatureWeights | None = None, representation: str = "acoustic", hybrid: HybridWeights | None = None, keys: Sequence[str] = KEYS) -> Result:
    """Interprets the retained observations again, without touching samples or frames.

    Settings of framing and grouping stay those of the source; other weights
    are laid on the retained coordinates.
    """
    asked = config or source.config
    resolved = replace(asked, acoustic=source.config.acoustic, grouping=replace(source.config.grouping, weights=weights or asked.grouping.weights))
    obs = source.observations
    if representation == "acoustic":
        obs = _reweighted(obs, O.weight_settings(resolved.grouping.weights, resolved.weighting))
    if representation == "hybrid" and source.representation != "acoustic":
        raise ValueError("a hybrid replays an acoustic source")
    rows = assign(obs, resolved, representation, hybrid, source.assignments, keys)
    return _result(obs, rows, resolved, keys, representation=representation, hybrid=hybrid, frames=source.frames, enhanced=source.enhanced, noise=source.noise, evidence=source.evidence)


def comparison(source: Result, other: Result, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per session: changed labels before and after smoothing, speakers with a profile, turns, cost."""
    count = lambda d, name: d.groupBy(*keys).agg(F.count("*").alias(name))
    out = other.evaluation.select(*keys, "representation", "cost", "normalized_cost")
    parts = [count(S.compared(source.assignments, other.assignments, keys, "speaker"), "clustering_changes"), count(S.compared(source.assignments, other.assignments, keys, "resolved_speaker"), "resolved_changes"), count(other.profiles, "n_speakers"), count(other.segments, "n_segments")]
    for p in parts:
        out = out.join(p, list(keys), "left")
    return out.fillna(0, ["clustering_changes", "resolved_changes", "n_speakers", "n_segments"])


def leave_one_out(source: Result, keys: Sequence[str] = KEYS) -> DataFrame:
    """One comparison per session and ablated feature family (or the enhanced view)."""
    weights = source.config.grouping.weights
    return _variants(source, [(t, weights.ablating(t), source.config.weighting) for t in ABLATION_TARGETS], "ablation", keys)


def experiment(source: Result, candidates: Sequence[tuple[str, FeatureWeights, str]], keys: Sequence[str] = KEYS) -> DataFrame:
    """One comparison per session and candidate (name, weights, weighting), numbered in the order given."""
    return _variants(source, candidates, "candidate", keys)


def hybrid_experiment(source: Result, candidates: Sequence[tuple[str, HybridWeights]], keys: Sequence[str] = KEYS) -> DataFrame:
    """One comparison per session and pair of authorities; sessions without a hybrid are missing."""
    out = None
    for i, (name, weights) in enumerate(candidates):
        replayed = replay(source, representation="hybrid", hybrid=weights, keys=keys)
        rows = comparison(source, replayed, keys).withColumns({"candidate": F.lit(name), "candidate_no": F.lit(i)})
        out = rows if out is None else out.unionByName(rows)
    return out


def contributions(source: Result, keys: Sequence[str] = KEYS) -> DataFrame:
    """Which feature families the distance of each observation to its speaker's centroid comes from."""
    rows = source.assignments.select(*keys, "obs_id", "vector", "centroid").join(source.observations.select(*keys, "obs_id", "coordinates"), [*keys, "obs_id"])
    return S.feature_contributions(rows, [*keys, "obs_id"], "vector", "centroid", "coordinates")
