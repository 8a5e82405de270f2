"""Range partitions as the pieces of large ordered groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edaflux.session import settle

# Rows that one piece should hold where the number of rows is known.
PIECE_ROWS = 65_536


def range_parts(
    df: DataFrame, by: Sequence[str | Column], name: str = "_part", rows: int | None = None, keep: Callable[[DataFrame], DataFrame] = settle
) -> DataFrame:
    """``df``, stored by ``keep``, with the number ``name`` of its range partition: it never decreases along ``by``, and
    rows that are equal in ``by`` share it.

    Bounds are sampled from the rows, so a group of any share of them is cut into pieces of even size if ``by`` goes on
    behind the group's keys. With ``rows`` there are as many pieces as that number asks for, and for all but tiny tables
    no fewer than the session's shuffle partitions. Without it there are as many as shuffle partitions, and adaptive
    execution merges neighbours up to its advisory size, so that pieces grow in number with the table and not in size.
    """
    if rows is None:
        cut = df.repartitionByRange(*by)
    else:
        shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cut = df.repartitionByRange(max(1, -(-rows // PIECE_ROWS), min(shuffles, rows // 1024)), *by)
    return keep(cut.withColumn(name, F.spark_partition_id()))
