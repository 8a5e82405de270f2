"""Linear gap filling by position in an ordered series.

The rows of all series are cut into range partitions of (series, time), whose number grows with the rows: a long or dense
series is many pieces, many short ones are one. Windows run inside one (series, piece), and a short table with one row for
each carries across the borders of pieces what the windows cannot see, forwards and backwards: how many rows came before,
the last known value before, the first known value after.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edaflux.operators.ordering import range_parts
from edaflux.operators.ranking import group_key


def _known(column: str) -> Column:
    """Position and value where there is one; the struct is null elsewhere."""
    return F.when(F.col(column).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(column).alias("v")))


def fill_gaps(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str]) -> DataFrame:
    """Fill nulls between two known values of the same series; nulls at either end stay null.

    Distance is counted in rows, so rows for missing times must be present with nulls. ``ts`` must be unique within
    a series.
    """
    part = ["_k", "_chunk"]
    cut = range_parts(df.withColumn("_k", group_key(keys)), ["_k", ts], "_chunk")
    forward = Window.partitionBy(*part).orderBy(ts)
    numbered = cut.withColumn("_at", F.row_number().over(forward).cast("long"))

    edges = numbered.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.min(_known(c)).alias(f"_first_{c}") for c in columns],
        *[F.max(_known(c)).alias(f"_last_{c}") for c in columns],
    )
    chunks = Window.partitionBy("_k").orderBy("_chunk")
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    for c in columns:
        for end in ("first", "last"):
            known = F.col(f"_{end}_{c}")
            shifted = F.struct((known["at"] + F.col("_offset")).alias("at"), known["v"].alias("v"))
            edges = edges.withColumn(f"_{end}_{c}", F.when(known.isNotNull(), shifted))
    # Looking ahead is looking back along the reversed order: a growing frame, not a shrinking one.
    after = Window.partitionBy("_k").orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *part, "_offset",
        *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns],
        *[F.last(f"_first_{c}", ignorenulls=True).over(after).alias(f"_ahead_{c}") for c in columns],
    )

    placed = numbered.join(carried, part).withColumn("_at", F.col("_at") + F.col("_offset"))
    back = Window.partitionBy(*part).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    fore = Window.partitionBy(*part).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    found = placed.select(
        "*",
        *[F.last(_known(c), ignorenulls=True).over(back).alias(f"_prev_{c}") for c in columns],
        *[F.last(_known(c), ignorenulls=True).over(fore).alias(f"_next_{c}") for c in columns],
    )
    filled = {}
    for c in columns:
        prev, nxt = F.coalesce(f"_prev_{c}", f"_carry_{c}"), F.coalesce(f"_next_{c}", f"_ahead_{c}")
        # A known row is its own neighbour on both sides and takes the first branch.
        slope = F.try_divide(nxt["v"] - prev["v"], (nxt["at"] - prev["at"]).cast("double"))
        filled[c] = F.coalesce(F.col(c), prev["v"] + slope * (F.col("_at") - prev["at"]))
    return found.select(*[filled[c].alias(c) if c in columns else F.col(c) for c in df.columns])
