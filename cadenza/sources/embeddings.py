"""Speaker embeddings from outside: a provider function or a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalized

#: (samples of a window, rate) -> vector or None. Called in the executors.
Provider = Callable[[np.ndarray, int], Sequence[float] | None]
DIMENSION = 256


def provided(windows: DataFrame, provider: Provider, keys: Sequence[str] = ("session_id", "obs_id")) -> DataFrame:
    """(keys, embedding) of windows with samples and sample_rate; windows the provider has nothing for are missing."""
    schema = ", ".join(f"{k} {dict(windows.dtypes)[k]}" for k in keys) + ", embedding array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [provider(np.asarray(x, np.float32), int(r)) for x, r in zip(b["samples"], b["sample_rate"], strict=True)]
            out = b[list(keys)].assign(embedding=[None if f is None else [float(v) for v in f] for f in found])
            yield out[out["embedding"].notna()]

    return windows.select(*keys, "samples", "sample_rate").mapInPandas(run, schema)


def admitted(embeddings: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """Embeddings of the right dimension, at unit length; others are dropped."""
    right = embeddings.where(F.size("embedding") == dimension).withColumn("embedding", l2_normalized("embedding", single=True))
    return right.where(F.col("embedding").isNotNull())


def enriched(observations: DataFrame, embeddings: DataFrame, keys: Sequence[str] = ("session_id", "obs_id")) -> DataFrame:
    """Observations with their new embedding; where there is none the one they had stays."""
    new = embeddings.select(*keys, F.col("embedding").alias("_new"))
    old = F.col("embedding") if "embedding" in observations.columns else F.lit(None).cast("array<float>")
    return observations.join(new, list(keys), "left").withColumn("embedding", F.coalesce("_new", old)).drop("_new")


def clustering_evidence(representation: str):
    """struct<acoustic, embedding> of what a representation clusters on, null if the row lacks it."""
    has = F.col("embedding").isNotNull()
    none = F.lit(None)
    if representation == "acoustic":
        return F.struct(F.col("values").alias("acoustic"), none.cast("array<float>").alias("embedding"))
    if representation == "embedding":
        return F.when(has, F.struct(none.cast("array<double>").alias("acoustic"), F.col("embedding").alias("embedding")))
    if representation == "hybrid":
        return F.when(has, F.struct(F.col("values").alias("acoustic"), F.col("embedding").alias("embedding")))
    raise ValueError(f"no such representation: {representation}")
