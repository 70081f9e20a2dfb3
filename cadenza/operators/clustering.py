"""Per-session clustering of weighted vectors: farthest-first k-means, automatic k, label matching.

These loops need all observations of a session at once; a session has a few per
second of speech, so they run as grouped functions over numpy arrays. Ties go
to the first index everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DiarizationConfig

SQUARED, COSINE, FUSED = "standardized-weighted-squared-euclidean", "cosine", "fused-normalized-candidate-cost"
#: Entries (rows times dimensions) of a session that a grouped function accepts.
LARGEST = 200_000_000
#: Numbers of a model of centroids that is sent to every task.
MODEL = 4_000_000


@dataclass
class Clusters:
    labels: np.ndarray
    centroids: np.ndarray
    cost: float


def distances(vectors: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """(n, k) distances; an undefined cosine distance is 1."""
    if metric == COSINE:
        scale = np.sqrt((vectors**2).sum(1))[:, None] * np.sqrt((centroids**2).sum(1))[None]
        with np.errstate(divide="ignore", invalid="ignore"):
            similar = np.clip((vectors @ centroids.T) / scale, -1, 1)
        return np.where(scale > 1e-12, 1 - similar, 1.0)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)


def unit_rows(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which rows have a length at all."""
    norm = np.sqrt((vectors**2).sum(1, keepdims=True))
    good = norm[:, 0] > 1e-12
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 1e-12), good


def k_means(vectors: np.ndarray, weights: np.ndarray, k: int, iterations: int = 32, metric: str = SQUARED) -> Clusters:
    """Weighted Lloyd iterations from a farthest-first start; a cluster without weight keeps its centroid.

    The first seed is the first of the rows of greatest weight.
    """
    n = len(vectors)
    if not n:
        return Clusters(np.zeros(0, int), np.zeros((0, 0)), 0.0)
    k = min(max(1, k), n)
    cosine = metric == COSINE
    weights = np.maximum(0, weights) if cosine else weights
    centroids = vectors[[int(np.argmax(weights))]]
    floor = np.maximum(weights, 1e-9) if cosine else weights
    while len(centroids) < k:
        centroids = np.vstack([centroids, vectors[[int(np.argmax(distances(vectors, centroids, metric).min(1) * floor))]]])
    labels = np.zeros(n, int)
    for _ in range(iterations):
        before = labels
        labels = distances(vectors, centroids, metric).argmin(1)
        member = labels[:, None] == np.arange(k)
        total = (member * weights[:, None]).sum(0)
        sums = (member * weights[:, None]).T @ vectors
        fresh = np.where((total > 1e-12)[:, None], sums / np.where(total > 1e-12, total, 1.0)[:, None], centroids)
        if cosine:
            unit, good = unit_rows(fresh)
            fresh = np.where(good[:, None], unit, centroids)
        centroids = fresh
        if (labels == before).all():
            break
    cost = float((weights * distances(vectors, centroids, metric)[np.arange(n), labels]).sum())
    return Clusters(labels, centroids, cost)


def choose_k(vectors: np.ndarray, weights: np.ndarray, config: DiarizationConfig, metric: str = SQUARED) -> Clusters:
    """As many clusters as each further one still improves the cost enough and leaves none too small."""
    chosen = k_means(vectors, weights, 1, config.maximum_iterations, metric)
    most = min(config.maximum_speakers, max(1, len(vectors) // config.minimum_per_cluster), len(vectors))
    if metric == SQUARED and chosen.cost <= 1e-12:
        return chosen
    for k in range(2, most + 1):
        found = k_means(vectors, weights, k, config.maximum_iterations, metric)
        if np.bincount(found.labels, minlength=k).min() < config.minimum_per_cluster:
            break
        if (chosen.cost - found.cost) / max(chosen.cost, 1e-12) < config.minimum_improvement:
            break
        chosen = found
    return chosen


def cluster(vectors: np.ndarray, weights: np.ndarray, config: DiarizationConfig, metric: str = SQUARED) -> Clusters:
    if config.expected_speakers is not None:
        return k_means(vectors, weights, config.expected_speakers, config.maximum_iterations, metric)
    return choose_k(vectors, weights, config, metric)


def scaled_costs(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate costs in units of the second smallest distance, and the confidence of the nearest; (0, 1) for one cluster."""
    if d.shape[1] < 2:
        return np.zeros_like(d), np.ones(len(d))
    low = np.partition(d, 1, axis=1)[:, :2]
    second = np.maximum(low[:, 1], 1e-12)
    return d / second[:, None], np.clip(1 - low[:, 0] / second, 0, 1)


def match_labels(labels: np.ndarray, k: int, baseline: Sequence[str | None]) -> list[str]:
    """Names clusters after the baseline speakers they overlap most, greedily; then unused baseline names; then fresh ones.

    Order: overlap descending, cluster, name (as text). ``baseline`` holds each
    row's speaker, or null.
    """
    known = sorted({b for b in baseline if b is not None})
    if not known:
        return [f"speaker_{i + 1}" for i in range(k)]
    overlap: dict[tuple[int, str], int] = {}
    for c, b in zip(labels.tolist(), baseline, strict=True):
        if b is not None:
            overlap[c, b] = overlap.get((c, b), 0) + 1
    names: dict[int, str] = {}
    for (c, b), _ in sorted(overlap.items(), key=lambda x: (-x[1], x[0])):
        if c not in names and b not in names.values():
            names[c] = b
    fresh = 1
    for c in range(k):
        if c in names:
            continue
        spare = [b for b in known if b not in names.values()]
        if spare:
            names[c] = spare[0]
            continue
        while f"speaker_{fresh}" in names.values():
            fresh += 1
        names[c] = f"speaker_{fresh}"
    return [names[c] for c in range(k)]


def check_size(rows: int, dims: int) -> None:
    if rows * max(1, dims) > LARGEST:
        raise ValueError(f"a session of {rows} observations with {dims} dimensions is too large to cluster in one task; split the session")


def cluster_sessions(df: DataFrame, keys: Sequence[str], vector: str, weight: str | None = None, order: str = "obs_id", config: DiarizationConfig = DiarizationConfig(), metric: str = SQUARED) -> DataFrame:
    """Clusters each session: one row per row with cluster, n_clusters, cost, confidence and candidate costs.

    For the cosine metric rows are scaled to unit length; a session with a row
    that has none, or with rows of differing dimension, gets null results.
    """
    schema = T.StructType([*[df.schema[k] for k in keys], df.schema[order], T.StructField("cluster", T.IntegerType()), T.StructField("n_clusters", T.IntegerType()), T.StructField("cost", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("costs", T.ArrayType(T.DoubleType())), T.StructField("distances", T.ArrayType(T.DoubleType()))])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        sizes = rows["_v"].map(lambda v: -1 if v is None else len(v))
        out = rows[[*keys, order]].copy()
        vectors = None
        if sizes.min() > 0 and (metric != COSINE or sizes.min() == sizes.max()):
            check_size(len(rows), int(sizes.min()))
            vectors = np.array([np.asarray(v, float)[: sizes.min()] for v in rows["_v"]])
            if metric == COSINE:
                vectors, good = unit_rows(vectors)
                vectors = vectors if good.all() else None
        if vectors is None:
            return out.assign(cluster=None, n_clusters=None, cost=None, confidence=None, costs=None, distances=None)
        found = cluster(vectors, rows["_w"].to_numpy(float), config, metric)
        d = distances(vectors, found.centroids, metric)
        costs, sure = scaled_costs(d)
        return out.assign(cluster=found.labels, n_clusters=len(found.centroids), cost=found.cost, confidence=sure, costs=list(costs), distances=list(d))

    prepared = df.select(*keys, order, F.col(vector).cast("array<double>").alias("_v"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"))
    return prepared.groupBy(*keys).applyInPandas(run, schema)


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, vector: str, centroid: str, centroid_id: str, metric: str = SQUARED) -> DataFrame:
    """Adds to each vector its nearest centroid and the distance, the least id of equally near ones.

    ``centroids`` is a small fixed table (a model): it is gathered into one
    array and sent to every task, so vectors are neither joined nor shuffled. A
    model of more than MODEL numbers is refused.
    """
    from ..functions import vectors as V

    held = centroids.agg(F.sum(F.size(centroid))).first()[0] or 0
    if held > MODEL:
        raise ValueError(f"a model of {held} numbers is too large to be sent to every task")
    model = centroids.agg(F.array_sort(F.collect_list(F.struct(F.col(centroid_id).alias("i"), F.col(centroid).cast("array<double>").alias("c")))).alias("_model"))
    joined = vectors.crossJoin(F.broadcast(model))
    each = F.transform("_model", lambda m: F.struct(V.clustering_distance(F.col(vector), m["c"], metric).alias("distance"), m["i"].alias("id")))
    best = F.array_min(each)
    return joined.withColumn("_best", best).withColumns({"nearest": F.col("_best.id"), "distance": F.col("_best.distance")}).drop("_model", "_best")
