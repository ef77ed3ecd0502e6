"""Clusters, projections and small fits.

Points stay distributed; what comes to the driver is a model of fixed size
(centroids, moments), never the points.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import small


def kmeans(points: DataFrame, vector: str, k: int, seed: int = 1, rounds: int = 20) -> tuple[DataFrame, float]:
    """(points with cluster, silhouette)."""
    v = points.withColumn("_v", array_to_vector(vector))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_v", predictionCol="cluster").fit(v)
    out = model.transform(v)
    quality = ClusteringEvaluator(featuresCol="_v", predictionCol="cluster").evaluate(out) if k > 1 else 0.0
    return out.drop("_v"), quality


def best_kmeans(points: DataFrame, vector: str, ks: list[int], seed: int = 1) -> tuple[DataFrame, int]:
    """The clustering with the best silhouette; of equals the smaller k."""
    tried = [(k, *kmeans(points, vector, k, seed)) for k in ks]
    k, out, _ = max(tried, key=lambda x: (round(x[2], 9), -x[0]))
    return out, k


def pca(points: DataFrame, vector: str, n: int) -> DataFrame:
    """points with their n principal scores; scores are of centred vectors."""
    size = points.select(F.size(vector)).first()[0]
    means = points.agg(*[F.avg(F.col(vector)[i]).alias(str(i)) for i in range(size)]).first()
    shift = F.array(*[F.lit(float(m)) for m in means])
    v = points.withColumn("_v", array_to_vector(F.zip_with(vector, shift, lambda x, m: x - m)))
    return PCA(k=min(n, 50, size), inputCol="_v", outputCol="_s").fit(v).transform(v).withColumn("scores", vector_to_array("_s")).drop("_v", "_s")


def merge_small(points: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """points with ``cluster``: clusters under the median size join the nearest large centroid; numbers are dense by name.

    Clusters are few; the table of their centroids is joined with itself.
    """
    c = points.groupBy(key).agg(F.count("*").alias("n"), F.array(*[F.avg(F.col(vector)[i]) for i in range(size)]).alias("m"))
    c = c.crossJoin(F.broadcast(c.agg(F.percentile("n", F.lit(0.5)).alias("q"))))
    few, large = c.filter("n < q").select(F.col(key), "m"), c.filter("n >= q").select(F.col(key).alias("to"), F.col("m").alias("t"))
    d = F.aggregate(F.zip_with("m", "t", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = few.crossJoin(small(large)).groupBy(key).agg(F.min_by("to", F.struct(F.round(d, 12), F.col("to"))).alias("to"))
    moved = points.join(small(near), key, "left").withColumn("_f", F.coalesce("to", key)).drop("to")
    names = moved.select("_f").distinct().withColumn("cluster", (F.row_number().over(Window.orderBy("_f")) - 1).cast("int"))
    return moved.join(small(names), "_f").drop("_f")


def gaussian_fit(points: DataFrame, key: str, vector: str, size: int, shrink: float = 0.1) -> list[dict]:
    """Mean, shrunk covariance, its log determinant and the prior of each cluster, from moments."""
    moments = [F.avg(F.col(vector)[i] * F.col(vector)[j]).alias(f"m{i}_{j}") for i in range(size) for j in range(i, size)]
    rows = points.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(F.col(vector)[i]).alias(f"a{i}") for i in range(size)], *moments).orderBy(key).collect()
    total = sum(r["n"] for r in rows)
    out = []
    for r in rows:
        mean = np.array([r[f"a{i}"] for i in range(size)])
        cov = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] - mean[i] * mean[j] for j in range(size)] for i in range(size)])
        cov = (1 - shrink) * cov + shrink * np.trace(cov) / size * np.eye(size) + 1e-9 * np.eye(size)
        out.append({"key": r[key], "mean": mean, "covariance": cov, "logdet": float(np.linalg.slogdet(cov)[1]), "prior": r["n"] / total})
    return out


def poisson_ridge(rows: DataFrame, features: list[str], target: str, ridge: float, steps: int = 25, bound: float = 10.0) -> np.ndarray:
    """Coefficients (intercept first) of a penalised Poisson fit on standardised features.

    Each Newton step is one aggregate of the gradient and the Hessian.
    """
    mean_sd = rows.agg(*[F.avg(f).alias(f"m{f}") for f in features], *[F.stddev_pop(f).alias(f"s{f}") for f in features], F.avg(target).alias("y")).first()
    x = [F.lit(1.0)] + [(F.col(f) - mean_sd[f"m{f}"]) / max(mean_sd[f"s{f}"] or 0.0, 1e-8) for f in features]
    beta = np.zeros(len(x))
    beta[0] = math.log(max(mean_sd["y"] or 0.0, 1e-8))
    for _ in range(steps):
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
        mu = F.exp(F.least(F.greatest(eta, F.lit(-30.0)), F.lit(30.0)))
        gradient = [F.avg((F.col(target) - mu) * c) for c in x]
        hessian = [F.avg(mu * x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
        r = list(rows.agg(*gradient, *hessian).first())
        g, h = np.array(r[: len(x)]), np.zeros((len(x), len(x)))
        h[np.triu_indices(len(x))] = r[len(x) :]
        h = h + np.triu(h, 1).T
        penalty = np.full(len(x), ridge)
        penalty[0] = 0.0
        step = np.linalg.solve(h + np.diag(penalty) + 1e-12 * np.eye(len(x)), g - penalty * beta)
        beta = np.clip(beta + np.clip(step, -2, 2), -bound, bound)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Non-negative least squares of a small system by coordinate descent."""
    x = np.zeros(a.shape[1])
    gram, rhs = a.T @ a, a.T @ b
    for _ in range(rounds):
        before = x.copy()
        for j in range(len(x)):
            if gram[j, j] > 0:
                x[j] = max(0.0, x[j] + (rhs[j] - gram[j] @ x) / gram[j, j])
        if np.abs(x - before).max() < 1e-12:
            break
    return x
