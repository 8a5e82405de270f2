"""Exact order statistics of groups of any size.

A group may hold a third of all rows, so no group is ever sorted or buffered by one task. Rows first collapse to
(group, distinct value, copies) with map-side combine. These are cut into range partitions of (group, value), whose number grows
with the table and not with the groups; the totals of each group in each partition are prefix-summed per group (a short table),
and values are ordered only inside their partition. Partition start plus position inside it is the exact rank. Mean, sd,
quantiles and CRPS all come from these rows.

NaN counts as missing. Infinite values are members with a rank like any other, and quantiles may be infinite; the sd, the
pairwise spread and the CRPS of a group that holds one are null, as they have no number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edaflux.operators.ordering import range_parts
from edaflux.schemas import QUANTILES


def group_key(keys: Sequence[str]) -> Column:
    """The group's keys as one struct. Structs match field by field with null equal to null, so groups with a null key
    are kept, and aggregates, windows and joins on it share one partitioning where null-safe joins on the separate
    columns would shuffle again."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))


def unpacked(keys: Sequence[str]) -> list[Column]:
    """The separate key columns again."""
    return [F.col("_k")[k].alias(k) for k in keys]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null matches null; the right side's copy of the keys is dropped."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def keyed_ranks(
    keyed: DataFrame, value: str, observed: DataFrame | None = None, shared: Sequence[str] = ()
) -> DataFrame:
    """Distinct values of each group ``_k`` with ``copies``, ``below``, and the group's ``size`` and ``mean``.

    A group with nulls also has one row of a null value with no copies, so groups of nulls alone stay visible.
    ``observed`` (struct ``_s`` of the ``shared`` keys, and an observation) is attached per group and keeps only
    observed groups; it meets the short bucket table, never the members. Each distinct observation is one set of rows.
    """
    # Negative zero and zero are one value; NaN is missing.
    clean = F.when(~F.isnan(value), F.col(value) + F.lit(0.0))
    copies = keyed.groupBy("_k", clean.alias("_value")).agg(F.count(clean).alias("copies"))
    counts = range_parts(copies, ["_k", "_value"], "_bucket")
    totals = counts.groupBy("_k", "_bucket").agg(
        F.sum("copies").alias("_in_bucket"), F.sum(F.col("copies") * F.col("_value")).alias("_bucket_sum")
    )
    group = Window.partitionBy("_k")
    ordered = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    starts = totals.select(
        "_k", "_bucket", (F.sum("_in_bucket").over(ordered) - F.col("_in_bucket")).alias("_start"),
        F.sum("_in_bucket").over(group).alias("size"),
        F.try_divide(F.sum("_bucket_sum").over(group), F.sum("_in_bucket").over(group)).alias("mean"),
    )
    extra: list[str] = []
    if observed is not None:
        extra = [c for c in observed.columns if c != "_s"]
        observed = observed.distinct()
        starts = starts.withColumn("_s", F.struct(*[F.col("_k")[c].alias(c) for c in shared])).join(observed, "_s").drop("_s")
    # A group observed several times has all its members once for each observation.
    inside = Window.partitionBy("_k", "_bucket", *extra).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(starts, ["_k", "_bucket"]).select(
        "_k", F.col("_value").alias(value), "copies",
        (F.col("_start") + F.sum("copies").over(inside) - F.col("copies")).alias("below"), "size", "mean", *extra,
    )


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with ``copies``, ``below`` (members strictly smaller) and ``size`` (members in the group)."""
    ranks = keyed_ranks(df.select(group_key(keys).alias("_k"), value), value).where(F.col("copies") > 0)
    return ranks.select(*unpacked(keys), value, "copies", "below", "size")


def quantiles_of_ranks(value: str, probabilities: Mapping[str, float]) -> list[Column]:
    """Type-7 quantile aggregates over the rows of ``value_ranks``."""
    out = []
    for name, p in probabilities.items():
        position = (F.col("size") - 1) * F.lit(p)

        def holds(rank: Column) -> Column:
            return (F.col("below") <= rank) & (rank < F.col("below") + F.col("copies"))

        low = F.max(F.when(holds(F.floor(position)), F.col(value)))
        high = F.max(F.when(holds(F.ceil(position)), F.col(value)))
        fraction = F.max(position - F.floor(position))
        # Between equal values, or exactly at one, nothing is interpolated: zero times infinity is no number.
        mixed = (F.lit(1.0) - fraction) * low + fraction * high
        out.append(F.when((fraction == 0) | (low == high), low).otherwise(mixed).alias(name))
    return out


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float] = QUANTILES
) -> DataFrame:
    """Exact type-7 quantiles per group; groups without a value do not appear."""
    keyed = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(group_key(keys).alias("_k"), value)
    out = keyed_ranks(keyed, value).groupBy("_k").agg(*quantiles_of_ranks(value, probabilities))
    return out.select(*unpacked(keys), *probabilities)


def moments_of_ranks(value: str) -> list[Column]:
    """Mean and sd aggregates over the rows of ``keyed_ranks``; deviations are taken from the exact group mean."""
    deviation = F.col(value) - F.col("mean")
    squares = F.sum(F.col("copies") * deviation * deviation)
    more = F.when(F.max("size") > 1, (F.max("size") - 1).cast("double"))
    sd = F.sqrt(squares / more)
    mean = F.max("mean")
    return [F.when(~F.isnan(mean), mean).alias("mean"), F.when(F.abs(sd) < float("inf"), sd).alias("sd")]


def ensemble_summary(
    df: DataFrame, keys: Sequence[str], value: str = "value", probabilities: Mapping[str, float] = QUANTILES
) -> DataFrame:
    """Mean, sd and exact quantiles per group, nulls left out; an all-null group keeps a null row."""
    keyed = df.select(group_key(keys).alias("_k"), value)
    out = keyed_ranks(keyed, value).groupBy("_k").agg(*moments_of_ranks(value), *quantiles_of_ranks(value, probabilities))
    return out.select(*unpacked(keys), "mean", "sd", *probabilities)


def spread_of_ranks(value: str) -> Column:
    """Half the mean absolute difference of all ordered pairs, from ranks alone."""
    weight = F.col("copies") * (2 * F.col("below") + F.col("copies") - F.col("size"))
    spread = F.try_divide(F.sum(F.col(value) * weight), F.max("size").cast("double") * F.max("size"))
    return F.when(F.abs(spread) < float("inf"), spread)


def pairwise_spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean absolute difference over all ordered pairs of members, without forming a pair."""
    keyed = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(group_key(keys).alias("_k"), value)
    out = keyed_ranks(keyed, value).groupBy("_k").agg(
        F.max("size").alias("members"), (F.lit(2.0) * spread_of_ranks(value)).alias("mean_abs_difference")
    )
    return out.select(*unpacked(keys), "members", "mean_abs_difference")
