"""Long <-> wide and row binding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edaflux.schemas import QUANTILES


def widen(
    df: DataFrame, keys: Sequence[str], names: Sequence[str], variable: str = "variable", value: str = "prediction"
) -> DataFrame:
    """One column per listed variable. One shuffle with map-side combine, and no scan to find the names."""
    picks = [F.max(F.when(F.col(variable) == n, F.col(value))).alias(n) for n in names]
    return df.groupBy(*keys).agg(*picks)


def lengthen(
    df: DataFrame, keys: Sequence[str], names: Sequence[str], variable: str = "variable", value: str = "value"
) -> DataFrame:
    return df.unpivot(list(keys), list(names), variable, value)


def lengthen_compound(
    df: DataFrame, keys: Sequence[str], variables: Sequence[str], parts: Sequence[str], separator: str = "___"
) -> DataFrame:
    """Columns named ``variable<separator>part`` become rows by variable with one column per part."""
    rows = [
        F.struct(F.lit(v).alias("variable"), *[F.col(f"`{v}{separator}{p}`").alias(p) for p in parts])
        for v in variables
    ]
    return df.select(*keys, F.inline(F.array(*rows)))


def spread_quantiles(df: DataFrame, array: str = "quantiles", names: Mapping[str, float] = QUANTILES) -> DataFrame:
    """An array of quantiles, in the order of ``names``, becomes one column each."""
    return df.select(*[c for c in df.columns if c != array], *[F.col(array)[i].alias(n) for i, n in enumerate(names)])


def bind_rows(*frames: DataFrame, loose: bool = False) -> DataFrame:
    """UNION ALL by column name; ``loose`` fills columns a frame lacks with null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=loose), frames)
