"""Clustering and components of region profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import correlation_test
from .joins import common_keys
from .metagene import forward


def matrix(d: DataFrame, windows: int, min_count: int = 0, merge_strands: bool = True, fill: float | None = None) -> DataFrame:
    """(gene, context, vector): a region's densities along its windows.

    With merged strands '-' is reversed and regions without strand go. Missing windows become ``fill``; None: such regions go."""
    d = d.where(F.col("count") > min_count)
    if merge_strands:
        d = forward(d.where(F.col("strand").isin("+", "-")))
    m = d.groupBy("gene", "context", "fragment").agg((F.sum("sum") / F.sum("count")).alias("v")).groupBy("gene", "context").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("fragment").cast("int"), F.col("v")))).alias("cells"))
    v = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.element_at(F.col("cells"), i))
    if fill is None:
        return m.where(F.size("cells") == windows).select("gene", "context", v.alias("vector"))
    return m.select("gene", "context", F.transform(v, lambda x: F.coalesce(x, F.lit(fill))).alias("vector"))


def difference(a: DataFrame, b: DataFrame, key: str = "gene") -> DataFrame:
    """b - a on common names."""
    return a.select(key, F.col("vector").alias("va")).join(b.select(key, F.col("vector").alias("vb")), key).select(key, F.zip_with("vb", "va", lambda x, y: x - y).alias("vector"))


def kmeans(d: DataFrame, k: int = 8, tries: int = 10, seed: int = 0) -> DataFrame:
    """``d`` with ``label`` by k-means, the best of ``tries`` starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = d.withColumn("_features", array_to_vector("vector"))
    models = [KMeans(k=k, seed=seed + i, featuresCol="_features", predictionCol="label").fit(x) for i in range(tries)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(x).drop("_features")


def centroids(d: DataFrame, how: str = "mean") -> DataFrame:
    """(label, i, value)."""
    f = {"mean": F.avg, "median": F.median}[how]
    return d.select("label", F.posexplode("vector").alias("i", "v")).groupBy("label", "i").agg(f("v").alias("value"))


def module_correlation(d: DataFrame, key: str = "gene") -> DataFrame:
    """(key, label, r): Pearson correlation of each row with its centroid; null where either is constant."""
    v = d.select(key, "label", F.posexplode("vector").alias("i", "v"))
    j = v.join(centroids(d), ["label", "i"])
    n = F.count("*").cast("double")
    sx, sy, sxy, sxx, syy = (F.sum(c) for c in (F.col("v"), F.col("value"), F.col("v") * F.col("value"), F.col("v") * F.col("v"), F.col("value") * F.col("value")))
    g = j.groupBy(key, "label").agg((n * sxy - sx * sy).alias("c"), (n * sxx - sx * sx).alias("a"), (n * syy - sy * sy).alias("b"))
    return g.select(key, "label", F.when((F.col("a") > 1e-12) & (F.col("b") > 1e-12), F.col("c") / F.sqrt(F.col("a") * F.col("b"))).alias("r"))


def module_membership(d: DataFrame, windows: int, cutoff: float = 0.05, key: str = "gene") -> DataFrame:
    """Rows that correlate with their centroid at a p-value below ``cutoff``."""
    return module_correlation(d, key).withColumn("p_value", correlation_test("r", F.lit(windows))).where(F.col("p_value") < cutoff)


def identity(d: DataFrame, key: str = "gene") -> DataFrame:
    """Every row a cluster of its own, labelled by its name."""
    return d.withColumn("label", F.col(key).cast("string"))


def principal_components(matrix_: DataFrame, labels: list[str], k: int = 2) -> list[tuple]:
    """(component, label, loading, explained share) per sample; each component's largest loading is positive."""
    from pyspark.ml.feature import PCA, VectorAssembler

    x = VectorAssembler(inputCols=labels, outputCol="x").transform(matrix_)
    model = PCA(k=k, inputCol="x", outputCol="y").fit(x)
    pc = model.pc.toArray()
    pc = pc * np.sign(pc[np.abs(pc).argmax(axis=0), range(k)])
    return [(j, label, float(pc[i, j]), float(model.explainedVariance[j])) for j in range(k) for i, label in enumerate(labels)]


def shared_genes(samples: DataFrame, n: int) -> DataFrame:
    return common_keys(samples, ["gene"], "label", n)


def linkage_cut(x: np.ndarray, q: float = 0.5) -> np.ndarray:
    """Average-linkage clusters of a small collected matrix, cut at the q-quantile of the merge heights; labels from 0 by first row."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    groups, heights = {i: [i] for i in range(n)}, []
    while len(groups) > 1:
        i, j = np.unravel_index(d.argmin(), d.shape)
        heights.append((d[i, j], list(groups[i]), list(groups[j])))
        a, b = len(groups[i]), len(groups[j])
        d[i] = d[:, i] = (a * d[i] + b * d[j]) / (a + b)
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        groups[i] += groups.pop(j)
    label = np.arange(n)
    limit = np.quantile([h for h, *_ in heights], q) if heights else 0
    for h, a, b in heights:
        if h <= limit:
            label[a + b] = min(label[a + b])
    return np.unique(label, return_inverse=True)[1]
