"""Monthly observation and driver tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edaflux.functions.scalars import name_part, number_or_null
from edaflux.schemas import DRIVERS_CSV, SENSOR_MONTH_CSV, SENSOR_SITE_CSV, TARGETS_CSV

# Layout of each variable and the names its columns take.
LAYOUTS: dict[str, tuple[T.StructType, dict[str, str]]] = {
    "targets": (TARGETS_CSV, {"startDateTime": "datetime"}),
    "drivers": (DRIVERS_CSV, {}),
    "soil-env": (SENSOR_MONTH_CSV, {"startDateTime": "datetime", "SOILT": "TSOIL", "VSWC": "SOILW"}),
}


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN to null in every double column: the one place where missing values are normalised."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: number_or_null(c) for c in doubles}) if doubles else df


def read_csv(spark: SparkSession, folder: str, schema: T.StructType, names: str = "*.csv", recursive: bool = False) -> DataFrame:
    """Files of one layout; ``names`` is a glob on the file name, applied while listing."""
    reader = (
        spark.read.schema(schema).option("header", True).option("nullValue", "NA").option("pathGlobFilter", names)
    )
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return clean_numbers(reader.csv(folder))


def download_values(spark: SparkSession, folder: str, variable: str, year: int | str, month: int | str | None = None) -> DataFrame:
    """All monthly files of a year, or of one month, as one table. Other months' files are never opened."""
    schema, renames = LAYOUTS[variable]
    glob = f"*{int(year):04d}-{int(month):02d}*.csv" if month is not None else f"*{int(year):04d}-*.csv"
    return read_csv(spark, folder, schema, glob).withColumnsRenamed(renames)


def _available(spark: SparkSession, folder: str, variable: str, dates: Sequence[str] | None) -> DataFrame:
    schema, renames = LAYOUTS[variable]
    glob = "*{" + ",".join(dates) + "}*.csv" if dates else "*.csv"
    return read_csv(spark, folder, schema, glob).withColumnsRenamed(renames)


def targets_available(spark: SparkSession, folder: str, dates: Sequence[str] | None = None) -> DataFrame:
    """Observed fluxes of all months, or of the listed ``YYYY-MM``."""
    return _available(spark, folder, "targets", dates)


def drivers_available(spark: SparkSession, folder: str, dates: Sequence[str] | None = None) -> DataFrame:
    """Weather drivers of all months, or of the listed ``YYYY-MM``."""
    return _available(spark, folder, "drivers", dates)


def month_bounds(year: int, month: int | None = None) -> tuple[str, str]:
    """First day and the day after the last, of a year or a month."""
    if month is None:
        return f"{year:04d}-01-01", f"{year + 1:04d}-01-01"
    nxt = (year + 1, 1) if month == 12 else (year, month + 1)
    return f"{year:04d}-{month:02d}-01", f"{nxt[0]:04d}-{nxt[1]:02d}-01"


def in_period(df: DataFrame, year: int, month: int | None = None, ts: str = "datetime") -> DataFrame:
    """The same selection on a table: a range on the time column, which reaches the scan."""
    first, after = month_bounds(year, month)
    c = F.col(ts)
    kind = df.schema[ts].dataType.simpleString()
    return df.where((c >= F.lit(first).cast(kind)) & (c < F.lit(after).cast(kind)))


def in_month_list(df: DataFrame, dates: Sequence[str] | None, ts: str = "datetime") -> DataFrame:
    """Rows of the listed ``YYYY-MM``: one range per month, so row groups can still be skipped."""
    if not dates:
        return df
    c, kind = F.col(ts), df.schema[ts].dataType.simpleString()
    keep: Column = F.lit(False)
    for d in dates:
        first, after = month_bounds(int(d[:4]), int(d[5:7]))
        keep = keep | ((c >= F.lit(first).cast(kind)) & (c < F.lit(after).cast(kind)))
    return df.where(keep)


SITE_OF_SENSOR_FILE = r"soil_drivers-([A-Za-z0-9]{4})-\d{4}-\d{2}(?:\.\d+)?\.csv"
FILES = "{.csv,.*.csv}"  # of one name, which may fill several


def consolidate_sensor_month(spark: SparkSession, folder: str, month: str) -> DataFrame:
    """Per-site sensor files of a month as one table; the site is in the file name only."""
    reader = (
        spark.read.schema(SENSOR_SITE_CSV).option("header", True).option("nullValue", "NA")
        .option("pathGlobFilter", f"soil_drivers-*-{month}{FILES}").option("recursiveFileLookup", True)
    )
    rows = reader.csv(folder).select("*", F.col("_metadata.file_name").alias("_file"))
    out = rows.select(name_part("_file", SITE_OF_SENSOR_FILE).alias("site_id"), "startDateTime", "VSWC", "SOILT")
    return clean_numbers(out)


def consolidate_flux_month(spark: SparkSession, folder: str, month: str) -> DataFrame:
    """Per-site flux files of a month as one table; the site is a column of the file."""
    return read_csv(spark, folder, TARGETS_CSV, f"forecast_prediction-*-{month}{FILES}", recursive=True)


def from_both_sensor_layouts(monthly: DataFrame, per_site: DataFrame) -> DataFrame:
    """Two layouts with different column order, bound by name."""
    return monthly.unionByName(per_site)
