"""Distances between array columns, nearest neighbours and hybrid ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import bm25

RRF = 60


def _col(v) -> Column:
    if isinstance(v, str):
        return F.col(v)
    return v if isinstance(v, Column) else F.array(*(F.lit(float(x)) for x in v))


def _sum(a, b, f) -> Column:
    """Sum of f over the pairs; null for a null vector, an error for vectors of different lengths."""
    a, b = _col(a).cast("array<double>"), _col(b).cast("array<double>")
    total = F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double")).otherwise(total)


def dot_product(a, b) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def l2_distance(a, b) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def cosine_similarity(a, b) -> Column:
    """Null where either vector is zero."""
    norms = F.sqrt(_sum(a, a, lambda x, y: x * y)) * F.sqrt(_sum(b, b, lambda x, y: x * y))
    return F.when(norms > 0, dot_product(a, b) / norms)


def cosine_distance(a, b) -> Column:
    return 1 - cosine_similarity(a, b)


def vector_dims(a) -> Column:
    return F.size(_col(a))


METRICS = {"l2": l2_distance, "cosine": cosine_distance, "dot": lambda a, b: -dot_product(a, b)}


def vector_search(df: DataFrame, vec: str, query, key: str, k: int = 10, metric: str = "l2") -> DataFrame:
    """The k nearest rows with their distance, exact; each task keeps k rows, so nothing else moves."""
    return df.withColumn("distance", METRICS[metric](vec, query)).orderBy("distance", key).limit(k)


def hybrid_search(df: DataFrame, key: str, vec: str, query, text: str, words: str, k: int = 10, metric: str = "l2") -> DataFrame:
    """Reciprocal rank fusion of a vector ranking and a BM25 ranking, each of max(4k, 50) rows."""
    pool = max(4 * k, 50)
    by_vec = vector_search(df.select(key, vec), vec, query, key, pool, metric)
    by_vec = by_vec.select(key, F.col("distance").alias("vec_distance"), F.row_number().over(Window.orderBy("distance", key)).alias("_vr"))
    by_text = bm25(df.select(key, text), key, text, words).orderBy(F.col("score").desc(), key).limit(pool)
    by_text = by_text.select(key, F.col("score").alias("bm25_score"), F.row_number().over(Window.orderBy(F.col("score").desc(), key)).alias("_tr"))
    part = lambda rank: F.coalesce(F.lit(1.0) / (RRF + F.col(rank)), F.lit(0.0))
    fused = by_vec.join(by_text, key, "full_outer").select(key, "vec_distance", "bm25_score", (part("_vr") + part("_tr")).alias("fused_score"))
    return fused.orderBy(F.col("fused_score").desc(), key).limit(k)


def kmeans_cells(df: DataFrame, vec: str, k: int = 100, seed: int = 1, iterations: int = 25):
    """Coarse cells for approximate search: (model, df with a ``cell`` column), to be stored partitioned by cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_f", array_to_vector(F.col(vec).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="_f", predictionCol="cell").fit(rows)
    return model, model.transform(rows).drop("_f")


def probe_search(cells: DataFrame, model, vec: str, query: list[float], key: str, k: int = 10, probes: int = 8, metric: str = "l2") -> DataFrame:
    """Approximate k nearest: exact ranking within the ``probes`` cells whose centres are nearest to the query."""
    import numpy as np

    centres = np.array(model.clusterCenters())
    near = np.argsort(((centres - np.array(query)) ** 2).sum(1))[:probes]
    return vector_search(cells.where(F.col("cell").isin([int(c) for c in near])), vec, query, key, k, metric)
