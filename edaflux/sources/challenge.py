"""Challenge observations: several datasets, each holding some of the variables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edaflux.operators.filters import members_of
from edaflux.schemas import CHALLENGE_CSV
from edaflux.sources.observations import read_csv

# The dataset each variable is published in.
DATASET_OF_VARIABLE = {
    "abundance": "beetles",
    "richness": "beetles",
    "gcc_90": "phenology",
    "rcc_90": "phenology",
    "chla": "aquatics",
    "oxygen": "aquatics",
    "temperature": "aquatics",
    "le": "fluxes",
    "nee": "fluxes",
}


def datasets_of(variables: Sequence[str]) -> list[str]:
    """Each dataset once, however many of its variables are asked for."""
    return sorted({DATASET_OF_VARIABLE[v] for v in variables if v in DATASET_OF_VARIABLE})


def select_observations(
    observations: DataFrame, variables: Sequence[str], start: str, end: str, sites: Sequence[str]
) -> DataFrame:
    """Variables, an inclusive date range and sites."""
    rows = members_of(members_of(observations, "variable", variables), "site_id", sites)
    return rows.where(F.col("datetime").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def get_forecast_data(
    spark: SparkSession, paths: Mapping[str, str], start: str, end: str, variables: Sequence[str], sites: Sequence[str]
) -> DataFrame:
    """Observations from the (gzipped) CSV files of the datasets that hold the variables; ``paths`` is by dataset."""
    found = [read_csv(spark, paths[name], CHALLENGE_CSV, names="*.csv*") for name in datasets_of(variables)]
    if not found:
        return spark.createDataFrame([], CHALLENGE_CSV)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return select_observations(out, variables, start, end, sites)
