"""Standardisation and spectra (SCL1-9). Statistics are one row; spectra come from a Gramian summed where the rows are."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.operators.features import gramian


def fit_scale(df: DataFrame, columns: list[str], mask: Column | None = None) -> DataFrame:
    """One row: mean_<c> and sd_<c> (of the population) over the rows of the mask."""
    rows = df if mask is None else df.where(mask)
    return rows.agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), *(F.stddev_pop(c).alias(f"sd_{c}") for c in columns))


def apply_scale(df: DataFrame, stats: DataFrame, columns: list[str], floor: float | None = 1e-6) -> DataFrame:
    """SCL1/SCL2 with a floor of the deviation; SCL4 with none: a deviation of zero then divides by 1. Source statistics serve a target as they are."""
    sd = lambda c: F.greatest(F.col(f"sd_{c}"), F.lit(floor)) if floor else F.when(F.col(f"sd_{c}") > 0, F.col(f"sd_{c}")).otherwise(1.0)
    met = df.crossJoin(F.broadcast(stats))  # one row
    return met.withColumns({c: (F.col(c) - F.col(f"mean_{c}")) / sd(c) for c in columns}).select(*df.columns)


def target_scale(source: DataFrame, target: DataFrame, columns: list[str], how: str, train: Column, connected: Column) -> DataFrame:
    """SCL3: statistics for a target: source (the source's train rows), own_neurons (its connected rows) or own (all its rows)."""
    found = {"source": (source, train), "own_neurons": (target, connected), "own": (target, None)}
    if how not in found:
        raise ValueError(f"unknown scaling {how!r}: one of {', '.join(found)}")
    return fit_scale(found[how][0], columns, found[how][1])


def covariance(df: DataFrame, columns: list[str]) -> np.ndarray:
    n, s, g = gramian(df, columns)
    return (g - np.outer(s, s) / max(n, 1)) / max(n - 1, 1)


def rank_stats(eigenvalues: np.ndarray) -> dict:
    """SCL5/SCL8: effective rank exp(entropy of the spectrum) and stable rank; a point mass has 0."""
    e = np.maximum(np.asarray(eigenvalues, float), 0)
    if e.sum() <= 1e-12:
        return {"effective_rank": 0.0, "stable_rank": 0.0}
    p = e / e.sum()
    return {"effective_rank": float(np.exp(-(p * np.log(np.maximum(p, 1e-12))).sum())), "stable_rank": float(e.sum() / e.max())}


def effective_rank(df: DataFrame, columns: list[str]) -> float:
    """SCL5: of standardised columns."""
    c = covariance(df, columns)
    sd = np.sqrt(np.maximum(np.diag(c), 1e-12))
    return rank_stats(np.linalg.eigvalsh(c / np.outer(sd, sd)))["effective_rank"]


@lru_cache(maxsize=64)
def null_rank(n: int, d: int, draws: int = 3, width: int = 256) -> float:
    """SCL7: the effective rank of noise of the same shape: the mean of seeded draws at a width of at most 256, scaled to d."""
    w, rows = min(d, width), min(n, 4096)
    ranks = [rank_stats(np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2)["effective_rank"] for x in (np.random.default_rng(s).standard_normal((rows, w)) for s in range(draws))]
    return float(np.mean(ranks)) * d / w


def collapse_metrics(df: DataFrame, columns: list[str], dead: float = 0.01) -> dict:
    """SCL6: ranks of the centred spectrum, the ratio to noise, and the share of dead directions among the first min(n - 1, d)."""
    n = df.count()
    e = np.sort(np.maximum(np.linalg.eigvalsh(covariance(df, columns)), 0))[::-1][: max(0, min(n - 1, len(columns)))]
    stats = rank_stats(e)
    null = null_rank(n, len(columns)) if n > 1 else 0.0
    return stats | {"ratio_to_null": stats["effective_rank"] / null if null else 0.0, "dead_fraction": float((e < dead * e.mean()).mean()) if e.sum() > 0 else 1.0}


def null_projection(df: DataFrame, columns: list[str], targets: list[str], rounds: int = 1, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """SCL9: (means, projection) that takes out the directions from which the targets can be read, in rounds of ridge regression, QR and projection.
    The products of columns and targets are summed once; each round works on them."""
    d = len(columns)
    n, s, g = gramian(df, [*columns, *targets])
    c = g - np.outer(s, s) / n
    p = np.eye(d)
    for _ in range(rounds):
        b = np.linalg.solve(p @ c[:d, :d] @ p + ridge * np.trace(c[:d, :d]) / d * np.eye(d), p @ c[:d, d:])
        q, r = np.linalg.qr(p @ b)
        q = q[:, np.abs(np.diag(r)) > 1e-10]
        p = p - q @ (q.T @ p)
    return s[:d] / n, p


def null_space(df: DataFrame, columns: list[str], targets: list[str], rounds: int = 1, ridge: float = 1e-3) -> DataFrame:
    """SCL9: columns without those directions, as doubles; rows meet the projection in Arrow batches. A row with a null among the columns has null in all."""
    mean, p = null_projection(df, columns, targets, rounds, ridge)
    casted = df.withColumns({c: F.col(f"`{c}`").cast("double") for c in columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([np.asarray(b[c].to_numpy(zero_copy_only=False), dtype=float) for c in columns])
            gone = np.isnan(x).any(axis=1)
            x = (x - mean) @ p
            at = {c: i for i, c in enumerate(columns)}
            yield pa.RecordBatch.from_arrays([pa.array(x[:, at[c]], mask=gone) if c in at else b[c] for c in b.schema.names], schema=b.schema)

    return casted.mapInArrow(run, casted.schema)
