"""Vertical soil profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edaflux.operators.ranking import null_safe_join


def surface_gradient(
    profile: DataFrame, keys: Sequence[str], depth: str = "depth", value: str = "co2"
) -> DataFrame:
    """Gradient between the two shallowest depths and the value its line reaches at the surface.

    The two depths come from minima, which combine map-side, so a profile of any length is never sorted in a task.
    Repeated readings at one depth count once, with their mean. One depth alone gives nulls.
    """
    keys = list(keys)
    means = profile.where(F.col(depth).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, depth).agg(
        F.avg(value).alias("_v")
    )
    point = F.struct(F.col(depth).alias("z"), F.col("_v").alias("c"))
    first = means.groupBy(*keys).agg(F.min_by(point, depth).alias("a"))
    deeper = null_safe_join(means, first, keys).where(F.col(depth) > F.col("a.z"))
    second = deeper.groupBy(*keys).agg(F.min_by(point, depth).alias("b"))
    out = null_safe_join(first, second, keys, "left")
    gradient = F.try_divide(F.col("b.c") - F.col("a.c"), F.col("b.z") - F.col("a.z"))
    return out.select(
        *keys, gradient.alias("gradient"), (F.col("a.c") - gradient * F.col("a.z")).alias("surface_value")
    )
