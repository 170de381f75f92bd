"""Labels by k-means: fit, choice of k, assignment to stored centres, silhouette."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Candidates for k, and the k taken when no candidate separates.
K_RANGE = range(3, 11)
FALLBACK_K = 3
#: Rows from which the starting centres of the search for k are drawn, at most.
SEED_ROWS = 2000


def vector_stages(features: list[str], output: str = "scaled") -> list:
    """Assemble and standardise; a missing value passes as NaN and is masked after scoring."""
    return [
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
        StandardScaler(inputCol="features", outputCol=output, withMean=True, withStd=True),
    ]


def fit_labels(
    df: DataFrame, features: list[str], k: int = 7, seed: int = 42, label: str = "label", max_iter: int = 20
) -> PipelineModel:
    """Assemble, standardise and cluster; rows with a missing feature are not used."""
    means = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="scaled", predictionCol=label)
    return Pipeline(stages=[*vector_stages(features), means]).fit(df.dropna(subset=features))


def scaled_arrays(df: DataFrame, features: list[str]) -> DataFrame:
    """`x`: the standardised features of each complete row as an array (sample deviation, as in `vector_stages`)."""
    rows = df.dropna(subset=features)
    stats = rows.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_samp(c).alias(f"d{i}") for i, c in enumerate(features)]
    ).first()
    scaled = [
        (F.col(c).cast("double") - F.lit(stats[f"m{i}"])) / F.lit(stats[f"d{i}"]) if stats[f"d{i}"] else F.lit(0.0) for i, c in enumerate(features)
    ]
    return rows.select(F.array(*scaled).alias("x"))


def seeds(points: np.ndarray, most: int, seed: int) -> np.ndarray:
    """Up to `most` different starting centres, each drawn by its squared distance from those before it."""
    rng = np.random.default_rng(seed)
    chosen = [points[rng.integers(len(points))]]
    gap = ((points - chosen[0]) ** 2).sum(1)
    while len(chosen) < most and gap.max() > 0:
        chosen.append(points[rng.choice(len(points), p=gap / gap.sum())])
        gap = np.minimum(gap, ((points - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def _points(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy().reshape(batch.num_rows, width)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T, 0.0)


def _cluster_sums(vectors: DataFrame, centres: dict[int, np.ndarray], width: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every k and its clusters: rows, sum and sum of squares, from one scan that assigns each row to the centres of all k."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: (np.zeros(len(c)), np.zeros((len(c), width)), np.zeros(len(c))) for k, c in centres.items()}
        for batch in batches:
            x = _points(batch, width)
            squares = (x * x).sum(1)
            for k, c in centres.items():
                label = _distances(x, c).argmin(1)
                n, sums, inner = totals[k]
                n += np.bincount(label, minlength=len(c))
                inner += np.bincount(label, squares, minlength=len(c))
                np.add.at(sums, label, x)
        rows = [(k, i, n[i], sums[i].tolist(), inner[i]) for k, (n, sums, inner) in totals.items() for i in range(len(n))]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.float64()], strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "label", "n", "sums", "inner"])

    parts = vectors.mapInArrow(assign, "k int, label int, n double, sums array<double>, inner double")
    summed = parts.groupBy("k", "label").agg(
        F.sum("n").alias("n"), F.sum("inner").alias("inner"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(width)]).alias("sums")
    )
    found = {k: (np.zeros(len(c)), np.zeros((len(c), width)), np.zeros(len(c))) for k, c in centres.items()}
    for row in summed.collect():
        n, sums, inner = found[row["k"]]
        n[row["label"]], sums[row["label"]], inner[row["label"]] = row["n"], row["sums"], row["inner"]
    return found


def _silhouettes(vectors: DataFrame, centres: dict[int, np.ndarray], sums: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], width: int) -> dict[int, float]:
    """The mean silhouette of every k, from one scan; see `silhouette`."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = dict.fromkeys(centres, 0.0), 0
        for batch in batches:
            x = _points(batch, width)
            many += len(x)
            for k, c in centres.items():
                total[k] += point_scores(x, _distances(x, c).argmin(1), *sums[k]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([*total.values()], pa.float64()), pa.array([many] * len(total), pa.int64())], names=["k", "total", "n"])

    parts = vectors.mapInArrow(score, "k int, total double, n long").groupBy("k").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return {row["k"]: row["total"] / row["n"] for row in parts.collect() if row["n"]}


def point_scores(x: np.ndarray, label: np.ndarray, n: np.ndarray, sums: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """The silhouette of each point for squared distances, from the count, sum and sum of squares of every cluster."""
    size = np.maximum(n, 1.0)
    mean = (x * x).sum(1)[:, None] + (inner / size)[None, :] - 2 * (x @ sums.T) / size[None, :]
    mean = np.where(n[None, :] > 0, np.maximum(mean, 0.0), np.inf)
    rows = np.arange(len(x))
    own = mean[rows, label] * n[label] / np.maximum(n[label] - 1, 1)
    mean[rows, label] = np.inf
    nearest = mean.min(1) if mean.shape[1] > 1 else np.full(len(x), np.inf)
    widest = np.maximum(own, nearest)
    score = np.where(np.isfinite(nearest) & (widest > 0), (nearest - own) / np.where(widest > 0, widest, 1.0), 0.0)
    return np.where(n[label] > 1, score, 0.0)


def score_candidates(
    df: DataFrame, features: list[str], candidates=K_RANGE, seed: int = 42, max_iter: int = 20, sample: int = SEED_ROWS
) -> list[tuple[int, float]]:
    """Silhouette (squared Euclidean) of every k that yields at least two clusters.

    All k are clustered together: each iteration is one scan that assigns every row to the centres of all k and adds up
    all their clusters, and one more scan scores all of them. Starting centres are drawn from `sample` rows with the smallest hashes.
    """
    vectors = scaled_arrays(df, features).persist()
    try:
        width, total = len(features), vectors.count()
        drawn = vectors.orderBy(F.xxhash64("x"), "x").limit(sample).collect()
        wanted = [k for k in candidates if k < total]
        if not wanted:
            return []
        start = seeds(np.array([r["x"] for r in drawn]), max(wanted), seed)
        centres = {k: start[:k] for k in wanted if k <= len(start)}
        moving = dict(centres)
        for _ in range(max_iter):
            if not moving:
                break
            for k, (n, sums, _) in _cluster_sums(vectors, moving, width).items():
                new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[k])
                step = ((new - centres[k]) ** 2).sum(1).max()
                centres[k] = new
                moving[k] = new
                if step <= 1e-8:
                    del moving[k]
        sums = _cluster_sums(vectors, centres, width)
        scores = _silhouettes(vectors, centres, sums, width)
        return [(k, scores[k]) for k in centres if k in scores and (sums[k][0] > 0).sum() > 1]
    finally:
        vectors.unpersist()


def choose_k(scores: list[tuple[int, float]], fallback: int = FALLBACK_K) -> int:
    """The k of the best score; the smallest wins a tie."""
    return max(scores, key=lambda s: (s[1], -s[0]))[0] if scores else fallback


def nearest_centre(features: list[str], centres: list[tuple[int, list[float]]]) -> Column:
    """Label of the nearest stored centre, the smaller label at equal distance; NULL beside a missing feature.

    The centres are data, an array in the plan, so the expression does not grow with them.
    """
    stored = F.array(*[F.struct(F.lit(label).alias("label"), F.array(*[F.lit(float(v)) for v in c]).alias("at")) for label, c in centres])
    x = F.array(*[F.col(name).cast("double") for name in features])

    def rated(centre: Column) -> Column:
        gaps = F.zip_with(x, centre["at"], lambda a, b: (a - b) * (a - b))
        return F.struct(F.aggregate(gaps, F.lit(0.0), lambda total, v: total + v).alias("distance"), centre["label"].alias("label"))

    known = F.lit(True)
    for name in features:
        known = known & F.col(name).isNotNull()
    return F.when(known, F.array_min(F.transform(stored, rated))["label"])


def silhouette(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Mean silhouette for squared Euclidean distance, from per-cluster sums.

    The mean distance of a point to a cluster follows from the cluster's count,
    sum and sum of squares, so no pair of points is ever formed. A cluster of
    one point scores 0, as does a point as far from its own cluster as from the nearest
    other one. Rows without a label or with a missing feature are not scored. The sums of the few clusters go to the tasks as data.
    """
    width = len(features)
    rows = df.dropna(subset=[label, *features]).select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(label).cast("string").alias("label"))
    squared = F.aggregate("x", F.lit(0.0), lambda total, v: total + v * v)
    summed = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(squared).alias("inner"), F.array(*[F.sum(F.get("x", F.lit(j))) for j in range(width)]).alias("sums")
    ).collect()
    place = {r["label"]: i for i, r in enumerate(summed)}
    n, inner = (np.array([float(r[c]) for r in summed]) for c in ("n", "inner"))
    sums = np.array([r["sums"] for r in summed], float).reshape(len(summed), width)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array([place[v] for v in batch.column(1).to_pylist()], np.int64)
            scored = point_scores(_points(batch, width), labels, n, sums, inner) if len(labels) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(scored)], names=["value"])

    return rows.mapInArrow(score, "value double").agg(F.avg("value").alias("silhouette"))
