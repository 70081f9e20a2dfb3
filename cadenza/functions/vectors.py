"""Functions of array<double> columns, all higher-order expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clamp01, col


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once, also where f uses it for every entry of an array.

    An expression outside a lambda is otherwise inlined into it and computed
    anew for each entry.
    """
    return F.element_at(F.transform(F.array(value), f), 1)


def doubles(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def _shared(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_norm(v: Column | str) -> Column:
    return total(F.transform(doubles(v), lambda x: x * x))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    """Over the dimensions that both have."""
    a, b = _shared(doubles(a), doubles(b))
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def rms_distance(a: Column | str, b: Column | str) -> Column:
    """Root mean square difference over the shared dimensions; 0 without any."""
    n = F.least(F.size(doubles(a)), F.size(doubles(b)))
    return F.when(n > 0, F.sqrt(squared_distance(a, b) / n)).otherwise(F.lit(0.0))


def l2_normalized(v: Column | str, single: bool = False) -> Column:
    """Unit length, or null for a (nearly) zero vector; ``single`` rounds the entries to 32-bit floats."""
    v = doubles(v)

    def scaled(norm: Column) -> Column:
        unit = F.transform(v, lambda x: x / norm)
        return F.when((F.size(v) > 0) & (norm > 1e-12), unit.cast("array<float>") if single else unit)

    return bound(F.sqrt(squared_norm(v)), scaled)


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Clamped to [-1, 1]; null where dimensions differ, are none, or a vector is (nearly) zero."""
    a, b = doubles(a), doubles(b)
    scale = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 1e-12), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / scale)))


def embedding_distance(a: Column | str, b: Column | str) -> Column:
    """Cosine distance, null where it is undefined."""
    return F.lit(1.0) - cosine_similarity(a, b)


def clustering_distance(a: Column | str, b: Column | str, metric: str) -> Column:
    """Distance of a vector and a centroid; an undefined cosine distance is 1."""
    if metric == "cosine":
        return F.coalesce(embedding_distance(a, b), F.lit(1.0))
    if metric == "standardized-weighted-squared-euclidean":
        return squared_distance(a, b)
    raise ValueError("fused candidate costs are no distance of vectors")


def cosine_agreement(a: Column | str, b: Column | str) -> Column:
    """(cosine + 1) / 2 over the shared dimensions; two zero vectors agree, one does not with another; 0 without dimensions."""
    a, b = _shared(doubles(a), doubles(b))
    na, nb = squared_norm(a), squared_norm(b)
    scale = F.sqrt(na * nb)
    zero = F.when((na <= 1e-12) & (nb <= 1e-12), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.size(a) == 0, F.lit(0.0)).when(scale > 1e-12, clamp01((dot(a, b) / scale + 1.0) / 2.0)).otherwise(zero)


def centered(v: Column | str) -> Column:
    v = doubles(v)
    return bound(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean))


def sqrt_weighted(v: Column | str, weights: Column | str) -> Column:
    """Each entry times the root of its weight; missing weights are 1, negative ones 0."""
    return F.zip_with(doubles(v), F.slice(doubles(weights), F.lit(1), F.size(doubles(v))), lambda x, w: x * F.sqrt(F.greatest(F.lit(0.0), F.coalesce(w, F.lit(1.0)))))


def rms_magnitude(v: Column | str) -> Column:
    """Root mean square of the entries, 0 for none."""
    return F.when(F.size(col(v)) > 0, F.sqrt(squared_norm(v) / F.size(col(v)))).otherwise(F.lit(0.0))


def two_smallest(costs: Column | str) -> Column:
    return F.slice(F.array_sort(doubles(costs)), 1, 2)


def assignment_confidence(costs: Column | str) -> Column:
    """1 - nearest / second nearest, 1 for a single candidate."""
    low = two_smallest(costs)
    return F.when(F.size(low) < 2, F.lit(1.0)).otherwise(clamp01(1.0 - F.element_at(low, 1) / F.greatest(F.element_at(low, 2), F.lit(1e-12))))


def candidate_costs(distances: Column | str) -> Column:
    """Distances in units of the second smallest; 0 for a single candidate."""
    d = doubles(distances)
    scale = F.greatest(F.try_element_at(two_smallest(d), F.lit(2)), F.lit(1e-12))
    return F.when(F.size(d) > 1, bound(scale, lambda s: F.transform(d, lambda x: x / s))).otherwise(F.transform(d, lambda x: F.lit(0.0)))


def first_argmin(values: Column | str) -> Column:
    """Place (from 0) of the smallest entry, the first of equal ones."""
    return (F.array_position(col(values), F.array_min(col(values))) - 1).cast("int")


def fused_costs(acoustic: Column | str, embedding: Column | str, weight_acoustic: float, weight_embedding: float) -> Column:
    return F.zip_with(doubles(acoustic), doubles(embedding), lambda a, e: weight_acoustic * a + weight_embedding * e)


def fused_confidence(raw: Column | str) -> Column:
    """1 for one candidate, 0 where the second cost is (nearly) nothing, else 1 - nearest / second."""
    low = two_smallest(raw)
    second = F.try_element_at(low, F.lit(2))
    return F.when(F.size(low) < 2, F.lit(1.0)).when(second <= 1e-12, F.lit(0.0)).otherwise(clamp01(1.0 - F.element_at(low, 1) / second))
