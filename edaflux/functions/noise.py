"""Keyed Gaussian noise: the same row gets the same draw under any partitioning or retry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK_53 = (1 << 53) - 1


def keyed_uniform(seed: int, tag: str, keys: Sequence[Column | str]) -> Column:
    """A uniform in (0, 1) from a hash of the seed, a tag and the row's keys."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    bits = F.xxhash64(F.lit(seed), F.lit(tag), *cols).bitwiseAND(F.lit(_MASK_53))
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def keyed_gaussian(seed: int, tag: str, keys: Sequence[Column | str]) -> Column:
    """A standard normal by the Box-Muller transform of two keyed uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(keyed_uniform(seed, tag + "/r", keys)))
    return radius * F.cos(F.lit(2.0) * F.pi() * keyed_uniform(seed, tag + "/a", keys))
