"""Embedding clusters: centroids, similarity, scoring and selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.operators.running import position
from voxloom.plans.blocks import dealt, hot_keys, repeated
from voxloom.plans.stash import stash, stash_measured

MIN_CLUSTER = 500
#: Members of the largest cluster that a refinement keeps, or all if there are fewer.
REFINED = 5000
#: Centroids that are broadcast at most.
BROADCAST = 10_000
#: Rows that a silhouette is taken of, as in the original.
SILHOUETTE_ROWS = 5000
#: Numbers of clusters that the silhouette search tries.
SEARCHED = (10, 15, 20, 25, 30)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """A vector over its length; null for a zero vector."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / F.nullif(norm, F.lit(0.0))))


def _partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for pdf in batches:
        for label, part in pdf.groupby("cluster"):
            m = np.stack(part["vec"].to_numpy()).astype(np.float64)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = m[norm[:, 0] > 0] / norm[norm[:, 0] > 0]
            n, s = sums.get(label, (0, 0.0))
            sums[label] = n + len(m), s + m.sum(axis=0)
    kept = [(k, n, s) for k, (n, s) in sums.items() if n]
    if kept:  # lists of no rows have no type that Arrow could read as arrays
        yield pd.DataFrame(kept, columns=["cluster", "n", "s"])


def centroids(vectors: DataFrame, cluster: str, vec: str) -> DataFrame:
    """Unit centroid of the unit members of each cluster: ``cluster``, ``centroid``.

    Every partition sends one vector per cluster; zero and null vectors don't count.
    """
    rows = vectors.filter(F.col(vec).isNotNull() & F.col(cluster).isNotNull()).select(F.col(cluster).alias("cluster"), F.col(vec).alias("vec"))
    kind = dict(rows.dtypes)["cluster"]
    part = rows.mapInPandas(_partial_sums, f"cluster {kind}, n long, s array<double>")
    flat = part.select("cluster", F.posexplode("s").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"))
    whole = flat.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("s"))
    return whole.select("cluster", unit(F.col("s")).alias("centroid"))


def similarities(vectors: DataFrame, cluster: str, vec: str) -> DataFrame:
    """Every row with ``similarity``, the cosine to its cluster's centroid.

    The centroids are counted as they are written: up to ``BROADCAST`` of them go
    to every executor, so that no cluster is brought together; more are joined
    with hot clusters in blocks.
    """
    c, seen = stash_measured(centroids(vectors, cluster, vec).withColumnRenamed("cluster", cluster), n=F.count(F.lit(1)))
    norm = F.sqrt(dot(F.col(vec), F.col(vec)))
    if seen["n"] <= BROADCAST:
        both = vectors.join(F.broadcast(c), cluster)  # counted
    else:
        hot = hot_keys(vectors, [cluster])
        rest = [x for x in vectors.columns if x != cluster]
        both = dealt(vectors, [cluster], rest, hot, "__block").join(repeated(c, [cluster], hot, "__block"), [cluster, "__block"]).drop("__block")
    return both.withColumn("similarity", F.try_divide(dot(F.col(vec), F.col("centroid")), norm)).drop("centroid")


def cluster_stats(scored: DataFrame, cluster: str) -> DataFrame:
    """Size, share, mean and population deviation of similarity per cluster."""
    agg = scored.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("similarity"), 4).alias("mean_similarity"), F.round(F.stddev_pop("similarity"), 4).alias("std_similarity"))
    total = F.sum("size").over(Window.partitionBy())  # over clusters, a small table
    return agg.withColumn("percentage", F.round(F.col("size") / total * 100, 1))


def largest(stats: DataFrame, cluster: str, n: int = 1) -> DataFrame:
    """The ``n`` largest clusters, ties to the smaller id."""
    return stats.orderBy(F.desc("size"), cluster).limit(n)


def best(stats: DataFrame, cluster: str, least: int = MIN_CLUSTER) -> DataFrame:
    """The most consistent cluster of those of ``least`` members or more, or the largest if there is none such."""
    big = F.col("size") >= least
    return stats.orderBy(F.desc(big), F.when(big, -F.col("mean_similarity")), F.desc("size"), cluster).limit(1)


def top_n(scored: DataFrame, n: int, key: str) -> DataFrame:
    """The ``n`` rows nearest the centroid, ties by key."""
    return scored.orderBy(F.desc("similarity"), key).limit(n)


def top_n_per_cluster(scored: DataFrame, n: int, cluster: str, key: str, salts: int = 32) -> DataFrame:
    """The ``n`` nearest rows of every cluster; a hot cluster is cut down in salted parts first."""
    order = [F.desc("similarity"), F.col(key)]
    s = scored.withColumn("__salt", position(F.col(key)) % salts)
    part = s.withColumn("__r", F.row_number().over(Window.partitionBy(cluster, "__salt").orderBy(*order))).filter(F.col("__r") <= n)
    out = part.withColumn("rank", F.row_number().over(Window.partitionBy(cluster).orderBy(*order))).filter(F.col("rank") <= n)
    return out.drop("__salt", "__r")


def kmeans(vectors: DataFrame, vec: str, ks: Sequence[int] = SEARCHED, seed: int = 42, silhouette_rows: int = SILHOUETTE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Scalable stand-in for hierarchical clustering: bisecting k-means on unit vectors for each k, judged by silhouette.

    Every row is clustered; the silhouette is taken of about ``silhouette_rows``
    rows, chosen by a hash, or of all if there are fewer. Returns the rows with
    ``cluster_id`` under the first best k, and the scores; null and zero vectors
    are left out.
    """
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("features", unit(F.col(vec))).filter("features IS NOT NULL").withColumn("features", array_to_vector("features"))
    rows, seen = stash_measured(rows, n=F.count(F.lit(1)))  # every step of every fit reads it
    share = 1.0 if seen["n"] <= silhouette_rows else silhouette_rows / seen["n"]
    place = F.xxhash64("features", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    scores, top = [], None
    for k in ks:
        labelled = BisectingKMeans(k=k, seed=seed, predictionCol="cluster_id").fit(rows).transform(rows)
        score = ClusteringEvaluator(predictionCol="cluster_id").evaluate(labelled.filter(place < share))
        scores.append((k, float(score)))
        if top is None or score > top[0]:
            top = (score, labelled)
    return top[1].drop("features"), vectors.sparkSession.createDataFrame(scores, "k int, silhouette double")


def projected(vectors: DataFrame, vec: str) -> DataFrame:
    """Two principal components per row, a stand-in for a neighbour embedding: ``x``, ``y``."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.filter(F.col(vec).isNotNull()).withColumn("features", array_to_vector(F.col(vec).cast("array<double>")))
    out = PCA(k=2, inputCol="features", outputCol="pc").fit(rows).transform(rows)
    xy = vector_to_array("pc")
    return out.withColumns({"x": xy[0], "y": xy[1]}).drop("features", "pc")
