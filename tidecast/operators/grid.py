"""Hyper-parameter grids as DataFrames.

A grid is the Cartesian product of the parameter lists, a literal table of a
size that the caller fixes; every series is fitted with all sets in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The decomposition grid (5 x 4 x 2 = 40 sets).
DEFAULT_GRID = {
    "changepoint_prior_scale": [0.001, 0.005, 0.01, 0.05, 0.1],
    "seasonality_prior_scale": [0.1, 1.0, 5.0, 10.0],
    "seasonality_mode": ["additive", "multiplicative"],
}


def param_grid(spark: SparkSession, grid: Mapping[str, Sequence]) -> DataFrame:
    """``param_cross``: Cartesian product of the parameter lists, with a
    0-based ``param_id`` in list order (last parameter varies fastest)."""
    import itertools

    from tidecast.session import literal_frame

    names = list(grid)
    kinds = ["string" if all(isinstance(v, str) for v in grid[n]) else "double" for n in names]
    rows = []
    for pid, combo in enumerate(itertools.product(*[grid[n] for n in names])):
        rows.append(tuple(v if k == "string" else float(v) for v, k in zip(combo, kinds)) + (pid,))
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds)) + ", param_id int"
    return literal_frame(spark, rows, schema)


def top_param_sets(results: DataFrame, by: str = "mae", k: int = 10, keys: Sequence[str] = ("series_key",)) -> DataFrame:
    """``top_param_sets``: the k best parameter sets per series (a top-k)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.col(by).asc_nulls_last(), F.col("param_id"))
    return results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
