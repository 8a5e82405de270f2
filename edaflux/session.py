"""Session set-up, reliable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

from functools import reduce
from weakref import WeakSet

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only after it was measured and found to hold at most this many rows and bytes.
BROADCAST_MAX_ROWS = 100_000
BROADCAST_MAX_BYTES = 64 << 20

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "edaflux", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes (UTC, ANSI, AQE with skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, val in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, val)
    return builder.getOrCreate()


def ensure_utc(spark: SparkSession) -> SparkSession:
    """All dates are UTC dates; sessions made elsewhere may carry another zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or the checkpoint folder set on the context.

    A local-mode session that names neither uses a folder of its warehouse, which it shares with itself.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_settled"
    spark.sparkContext.setCheckpointDir(made)
    return made


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into reliable storage, so losing executors costs no recomputation. A settled table is itself."""
    if df in _settled:
        return df
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    table = df.checkpoint(eager=True)
    _settled.add(table)
    return table


_settled: WeakSet[DataFrame] = WeakSet()


def settle_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict[str, Column]]:
    """``df``, settled, and aggregates of it gathered in the same pass, as literals of their types.

    Repeated tasks repeat their rows, so the aggregates should not mind that: extremes, not sums.
    """
    seen = Observation()
    kinds = df.select(*[m.alias(k) for k, m in metrics.items()]).schema
    table = settle(df.observe(seen, *[m.alias(k) for k, m in metrics.items()]))
    return table, {f.name: F.lit(seen.get[f.name]).cast(f.dataType) for f in kinds}


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """The bytes of a value in memory, at most: eight for a fixed width, what is in it for the others."""
    zero = F.lit(0).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), zero) + 16
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, [value_bytes(value[f.name], f.dataType) for f in kind.fields], zero)
    if isinstance(kind, T.MapType):
        return sum((value_bytes(f(value), T.ArrayType(k)) for f, k in ((F.map_keys, kind.keyType), (F.map_values, kind.valueType))), zero)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.MapType, T.ArrayType)):
            inside = F.aggregate(value, zero, lambda a, e: a + value_bytes(e, kind.elementType))
        else:
            inside = F.size(value).cast("long") * 8
        return F.coalesce(inside, zero) + 16
    return F.lit(16 if isinstance(kind, T.DecimalType) else 8).cast("long")


def broadcast_if_small(table: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Hint a broadcast if the table's rows and bytes, counted, prove it small, else leave it alone.

    The count stops behind the bound of rows. Without the hint Spark runs a sort-merge join, and AQE splits hot keys of
    the larger side. Settle a table first if computing it twice would cost more than storing it.
    """
    row = value_bytes(F.struct(*[F.col(f"`{c}`") for c in table.columns]), table.schema) if table.columns else F.lit(0)
    n, size = table.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(row), F.lit(0))).head()
    return F.broadcast(table) if n <= max_rows and size <= max_bytes else table
