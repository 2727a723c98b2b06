"""Closeness formulas over (reach, dist_sum, size). Integer products are formed in LONG, cast, and divided once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def closeness_component(reach: Column, comp_size: Column, dist_sum: Column) -> Column:
    """((r-1)^2) / ((c-1) * D); 0 where nothing was reached. r excludes the source, c is its component's size."""
    top = ((reach - 1) * (reach - 1)).cast("double")
    return F.when((dist_sum > 0) & (reach > 0) & (comp_size > 0), top / ((comp_size - 1).cast("double") * dist_sum.cast("double"))).otherwise(F.lit(0.0))


def closeness_global(reach: Column, n_vertices: Column, dist_sum: Column) -> Column:
    """r^2 / ((N-1) * D); 0 where nothing was reached."""
    top = (reach * reach).cast("double")
    return F.when(dist_sum > 0, top / ((n_vertices - 1).cast("double") * dist_sum.cast("double"))).otherwise(F.lit(0.0))
