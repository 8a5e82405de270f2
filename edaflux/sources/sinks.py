"""Writing forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edaflux.schemas import DRIVERS_CSV, FORECAST_HORIZON, QUANTILE_FILE_NAMES, SUBMISSION_COLUMNS, TARGETS_CSV
from edaflux.sources.commits import staged


def write_daily_forecasts(summary: DataFrame, folder: str) -> None:
    """CSV with the published column names, one folder per forecast day; a rerun replaces only the days it holds.

    Rows are rebalanced by day: one file per day, unless a day outgrows the advisory partition size and is split.
    """
    named = summary.withColumnsRenamed(QUANTILE_FILE_NAMES)
    spread = named.withColumn("forecast_date", F.col("day")).hint("rebalance", "forecast_date")
    (
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True)
        .option("nullValue", "NA").partitionBy("forecast_date").csv(folder)
    )


def write_named_files(df: DataFrame, folder: str, name: Column, drop: Sequence[str] = ()) -> None:
    """CSV files called after ``name``, a function of the row; ``NA`` for nulls. The name is not a column of the file,
    nor are those of ``drop``.

    Rows are rebalanced by name: one file per name, numbered from the second on where a name outgrows a partition. They
    are written aside and then committed (``commits``): the files of a name are replaced as a whole, by the writer that
    commits last; files of names that ``df`` does not hold stay as they are.
    """
    named = df.withColumn("_name", name).drop(*drop).hint("rebalance", "_name")
    with staged(df.sparkSession, folder) as aside:
        named.write.option("header", True).option("nullValue", "NA").partitionBy("_name").csv(aside.path)


def write_horizon_forecasts(summary: DataFrame, folder: str) -> None:
    """Month-end horizon forecasts, one file for each month of forecast days, columns in the order of the files."""
    named = summary.select(*FORECAST_HORIZON.names).withColumnsRenamed(QUANTILE_FILE_NAMES)
    month_end = F.date_format(F.last_day("day"), "yyyy-MM-dd")
    write_named_files(named, folder, F.concat(F.lit("forecast_prediction_horizon-"), month_end))


def write_month_of_drivers(drivers: DataFrame, folder: str) -> None:
    """Daily weather drivers, one file for each month."""
    write_named_files(drivers.select(*DRIVERS_CSV.names), folder, F.concat(F.lit("drivers-"), F.date_format("datetime", "yyyy-MM")))


def write_month_of_targets(targets: DataFrame, folder: str) -> None:
    """Observed fluxes, one file for each month."""
    write_named_files(targets.select(*TARGETS_CSV.names), folder, F.concat(F.lit("targets-"), F.date_format("startDateTime", "yyyy-MM")))


def write_ensemble(long: DataFrame, folder: str) -> None:
    """The ensemble as Parquet by reference date, large dates split by AQE, sorted for row-group skipping."""
    (
        long.hint("rebalance", "reference_datetime")
        .sortWithinPartitions("reference_datetime", "variable", "site_id")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("reference_datetime").parquet(folder)
    )


def submission(
    predictions: DataFrame, project_id: str, model_id: str, duration: str = "P1D", variable: str = "soil_flux"
) -> DataFrame:
    """The ten standard columns in order; dates are UTC days."""
    filled = predictions.withColumns({
        "project_id": F.lit(project_id), "model_id": F.lit(model_id), "duration": F.lit(duration),
        "variable": F.lit(variable), "datetime": F.to_date("datetime"),
        "reference_datetime": F.to_date("reference_datetime"),
    })
    return filled.select(*SUBMISSION_COLUMNS)


def submission_problems(rows: DataFrame) -> DataFrame:
    """One row of checks on a submission: reference dates (should be 1), blank ids, model ids with spaces."""
    return rows.agg(
        F.count_distinct("reference_datetime").alias("reference_dates"),
        F.count_if(F.col("model_id").contains(" ")).alias("ids_with_space"),
        F.count_if(F.col("site_id").isNull() | F.col("datetime").isNull()).alias("rows_without_key"),
        F.count(F.lit(1)).alias("n"),
    )
