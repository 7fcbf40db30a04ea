"""Whole displacement analysis: points to background-corrected curves."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stipple.operators.decompose import decompose, dense_curves, guarded_summary
from stipple.operators.pairs import grouped_pair_counts, pair_counts, pool_scopes


def cell_curves(points: DataFrame, *, max_distance: float, n_bins: int) -> DataFrame:
    """Decomposed curve of every sample, one row per bin."""
    counts = pair_counts(points, max_distance=max_distance, n_bins=n_bins, by_frame=False)
    dense = dense_curves(counts, ["sample_id"], n_bins=n_bins, width=max_distance / n_bins)
    return decompose(dense, ["sample_id"], n_bins=n_bins)


def scoped_curves(counts: DataFrame, scopes: DataFrame, *, max_distance: float, n_bins: int) -> DataFrame:
    """Decomposed curve per sample, group and frame range, from saved per-frame counts."""
    keys = ["sample_id", "grp", "scope"]
    pooled = pool_scopes(counts.where("component in ('total', 'background')"), scopes)
    dense = dense_curves(pooled, keys, n_bins=n_bins, width=max_distance / n_bins)
    return decompose(dense, keys, n_bins=n_bins)


def grouped_summary(points: DataFrame, scopes: DataFrame, *, max_distance: float, n_bins: int) -> DataFrame:
    counts = grouped_pair_counts(points, max_distance=max_distance, n_bins=n_bins)
    curves = scoped_curves(counts, scopes, max_distance=max_distance, n_bins=n_bins)
    return guarded_summary(curves, ["sample_id", "grp", "scope"], n_bins=n_bins, width=max_distance / n_bins)
