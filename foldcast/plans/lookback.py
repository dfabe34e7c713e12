"""Windowed operators over a stretch of time: rows before it are read only as far as windows reach back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contract import SeriesSpec, count


def between(df: DataFrame, spec: SeriesSpec, low: object, high: object, reach: int, op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with low <= order < high of op(df), where op's windows reach at most ``reach`` rows back (lag, rolling).

    The range filter is pushed to the scan; of earlier rows each series keeps its last ``reach``, chosen before the
    shuffle already. Not for recurrences and running windows, which reach back to the beginning.
    """
    if len(spec.order) != 1:
        raise ValueError("a stretch needs one order column")
    t, back = F.col(spec.order[0]), count(reach, "reach")
    rank = F.row_number().over(Window.partitionBy(*spec.key).orderBy(t.desc()))
    before = df.where(t < F.lit(low)).withColumn("_back", rank).where(F.col("_back") <= back).drop("_back")
    inside = df.where((t >= F.lit(low)) & (t < F.lit(high)))
    return op(before.unionByName(inside)).where(t >= F.lit(low))
