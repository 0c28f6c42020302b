"""Vector operators over arrays of numbers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import arrays
from tickloom.workers import ship


def similarity_to(rows: DataFrame, vector: str, example: list[float]) -> DataFrame:
    """Cosine similarity of every row to one example vector."""
    return rows.withColumn("similarity", arrays.cosine(vector, F.array(*[F.lit(float(x)) for x in example])))


def example_vector(rows: DataFrame, key: str, value, vector: str) -> list[float]:
    row = rows.filter(F.col(key) == value).select(vector).first()
    if row is None:
        raise ValueError(f"no row with {key} {value}")
    return [float(x) for x in row[0]]


def similarity_map(rows: DataFrame, vector: str, example: list[float], low: float = 0.08, high: float = 0.98) -> DataFrame:
    """Similarities moved so that two percentiles become 0 and 1, and held there."""
    found = similarity_to(rows, vector, example)
    return quantile_rescaled(found, "similarity", low, high, out="level")


def quantile_rescaled(rows: DataFrame, value: str, low: float = 0.02, high: float = 0.98, scale: float = 1.0, keys: tuple[str, ...] = (), out: str = "scaled") -> DataFrame:
    """A value rescaled between two interpolated percentiles of its group; the bounds are one row a group."""
    bounds = rows.groupBy(*keys).agg(F.percentile(value, F.lit(low)).alias("_lo"), F.percentile(value, F.lit(high)).alias("_hi"))
    joined = rows.join(bounds, list(keys)) if keys else rows.join(F.broadcast(bounds), F.lit(True))
    return joined.withColumn(out, arrays.rescaled(value, "_lo", "_hi", scale)).drop("_lo", "_hi")


def nearest(rows: DataFrame, key: str, vector: str, example: list[float], k: int) -> DataFrame:
    """The ``k`` most similar rows; ties by key."""
    return similarity_to(rows, vector, example).orderBy(F.desc("similarity"), key).limit(k)


def pair_errors(a: Column | str, b: Column | str) -> list[Column]:
    return [arrays.mean_squared_error(a, b).alias("mse"), arrays.mean_absolute_error(a, b).alias("mae"), arrays.cosine(a, b).alias("cosine")]


def projected(rows: DataFrame, vector: str, dim: int, seed: int = 0) -> DataFrame:
    """A random orthonormal projection to ``dim`` dimensions, rounded to signed bytes with one scale a row."""
    ship(rows.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = None
        for pdf in frames:
            if pdf.empty:
                continue
            values = np.array(pdf[vector].tolist(), np.float64)
            if matrix is None:
                matrix = np.linalg.qr(np.random.default_rng(seed).standard_normal((values.shape[1], values.shape[1])))[0][:, :dim]
            low = values @ matrix
            scale = np.maximum(np.abs(low).max(1), 1e-12) / 127
            yield pdf.assign(code=list(np.rint(low / scale[:, None]).astype(int)), scale=scale)

    return rows.mapInPandas(run, f"{fields}, code array<int>, scale double")


def principal_axes(rows: DataFrame, vector: str, k: int = 3) -> tuple[list[float], np.ndarray]:
    """The mean and the first ``k`` principal axes. Sums and products are aggregated by Spark: what reaches the
    driver is one row for each pair of dimensions."""
    n = rows.select(F.size(vector).alias("d")).first()["d"]
    flat = rows.select(F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"), F.col(vector).cast("array<double>").alias("v"))
    sums = flat.groupBy("i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), *[F.sum(F.col("x") * F.get("v", F.lit(j))).alias(f"p{j}") for j in range(n)]).collect()
    mean, second = np.zeros(n), np.zeros((n, n))
    for r in sums:
        mean[r["i"]] = r["s"] / r["n"]
        second[r["i"]] = [r[f"p{j}"] / r["n"] for j in range(n)]
    values, axes = np.linalg.eigh(second - np.outer(mean, mean))
    return mean.tolist(), axes[:, np.argsort(-values)[:k]].T


def aligned_axes(axes: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The order and signs of ``axes`` that agree best with a reference."""
    choices = ((np.array(s)[:, None] * axes[list(p)]) for p in permutations(range(len(axes))) for s in product((1, -1), repeat=len(axes)))
    return max(choices, key=lambda m: float((m * reference).sum()))


def on_axes(rows: DataFrame, vector: str, mean: list[float], axes: np.ndarray) -> DataFrame:
    centred = F.zip_with(F.col(vector).cast("array<double>"), F.array(*map(F.lit, mean)), lambda x, m: x - m)
    return rows.withColumn("components", F.array(*[arrays.dot(centred, F.array(*[F.lit(float(x)) for x in axis])) for axis in axes]))


def best_shift(before: np.ndarray, after: np.ndarray, reach: int = 4, stride: int = 4) -> tuple[int, int, float]:
    """The shift of least mean absolute difference between two images; a kernel for pandas functions."""
    h, w = before.shape[:2]
    best = (0, 0, float("inf"))
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            a = before[max(0, dy) : h + min(0, dy) : stride, max(0, dx) : w + min(0, dx) : stride]
            b = after[max(0, -dy) : h + min(0, -dy) : stride, max(0, -dx) : w + min(0, -dx) : stride]
            score = float(np.abs(a.astype(float) - b.astype(float)).mean())
            if score < best[2]:
                best = (dx, dy, score)
    return best
