"""K-means for many numbers of clusters and many starts at once.

All centres of all fits stand in one matrix. A pass over the rows measures every row against all of them and sums the rows of each centre
in the task; one aggregate per iteration, of a size set by the grid alone, moves every fit on. Fits that have
come to rest take no further part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyback.session import cut_lineage, release

SEED_ROWS = 4096  # rows, drawn by hash of the key, from which the starts are taken
REST = 1e-4  # a fit rests when no centre moves farther than this


@dataclass
class Fit:
    centres: np.ndarray
    cost: float = np.inf
    moving: bool = True


def spread_start(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` rows far apart: each next one drawn with the squared distance to the nearest chosen as weight."""
    chosen = [rows[rng.integers(len(rows))]]
    while len(chosen) < k:
        far = ((rows[:, None, :] - np.array(chosen)[None]) ** 2).sum(2).min(1)
        chosen.append(rows[rng.choice(len(rows), p=far / far.sum())] if far.sum() > 0 else rows[rng.integers(len(rows))])
    return np.array(chosen)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(vectors: DataFrame, fits: list[Fit]) -> dict[int, tuple[int, float, np.ndarray]]:
    """Rows, summed squared distance and vector sum of every centre that has rows; numbered over all fits."""
    centres = np.vstack([f.centres for f in fits])
    borders = np.cumsum([0, *[len(f.centres) for f in fits]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost, total = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros_like(centres)
        for batch in batches:
            rows = _matrix(batch.column(0))
            if not len(rows):
                continue
            far = (rows * rows).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * rows @ centres.T
            for start, end in zip(borders, borders[1:]):
                own = far[:, start:end].argmin(1)
                n[start:end] += np.bincount(own, minlength=end - start)
                cost[start:end] += np.bincount(own, np.maximum(far[np.arange(len(rows)), start + own], 0), end - start)
                for d in range(rows.shape[1]):
                    total[start:end, d] += np.bincount(own, rows[:, d], end - start)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(centres))), pa.array(n), pa.array(cost), pa.array(total.tolist(), pa.list_(pa.float64()))], ["centre", "n", "cost", "total"]
        )

    summed = vectors.mapInArrow(add, "centre long, n long, cost double, total array<double>").groupBy("centre").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(F.get("total", F.lit(d))).alias(f"t{d}") for d in range(centres.shape[1])]
    )
    return {r["centre"]: (r["n"], r["cost"], np.array(r[3:])) for r in summed.collect()}


def fit_kmeans_grid(rows: DataFrame, key: str, features: str, ks: Iterable[int], starts: int, iterations: int, seed: int) -> dict[int, np.ndarray]:
    """Centres of the cheapest of ``starts`` fits for every k, each at most ``iterations`` steps long.

    Starts are spread over a draw of ``SEED_ROWS`` rows; steps read all rows. A centre that loses all its rows stays where it is.
    """
    vectors = cut_lineage(rows.select(vector_to_array(features).alias("v"), F.xxhash64(key, F.lit(seed)).alias("h")))
    drawn = [r["v"] for r in vectors.orderBy("h", "v").limit(SEED_ROWS).collect()]
    if not drawn:
        raise ValueError("k-means needs at least one row")
    rng = np.random.default_rng(seed)
    fits = {k: [Fit(spread_start(np.array(drawn), k, rng)) for _ in range(starts)] for k in ks}
    every = [f for group in fits.values() for f in group]
    for step in range(iterations + 1):
        active = [f for f in every if f.moving]
        if not active:
            break
        sums, at = _sums(vectors.select("v"), active), 0
        for fit in active:
            found = [sums.get(at + i, (0, 0.0, None)) for i in range(len(fit.centres))]
            at += len(fit.centres)
            fit.cost = sum(c for _, c, _ in found)
            moved = np.array([t / n if n else old for (n, _, t), old in zip(found, fit.centres)])
            far = np.sqrt(((moved - fit.centres) ** 2).sum(1).max())
            fit.moving = far > REST and step < iterations
            if fit.moving:
                fit.centres = moved
    release(vectors)
    return {k: min(group, key=lambda f: f.cost).centres for k, group in fits.items()}


def assign_clusters(rows: DataFrame, features: str, centres: np.ndarray, out: str) -> DataFrame:
    """Rows with the number of their nearest centre, ties to the smaller."""

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        data = np.stack([np.asarray(v, float) for v in vectors]) if len(vectors) else np.zeros((0, centres.shape[1]))
        return pd.Series(((data[:, None, :] - centres[None]) ** 2).sum(2).argmin(1).astype("int32"))

    return rows.withColumn(out, nearest(vector_to_array(features)))
