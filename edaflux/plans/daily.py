"""The daily forecast: four models on one ensemble run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edaflux.functions.dates import day_of, training_month, training_year
from edaflux.functions.scalars import kelvin_to_celsius
from edaflux.operators.aggregate import earliest, ensemble_summary
from edaflux.operators.boosted import fit_boosted, predict_boosted
from edaflux.operators.evaluate import score_ensemble
from edaflux.operators.filters import first_day, forecast_day
from edaflux.operators.joins import pair_training_rows
from edaflux.operators.predict import coefficient_rows, predict_models, predict_null_model
from edaflux.operators.regression import fit_soil_exponential, fit_soil_linear
from edaflux.operators.reshape import bind_rows
from edaflux.schemas import FORECAST_HORIZON
from edaflux.session import settle

VALUE_COLUMNS = ("site_id", "reference_datetime", "ensemble", "datetime", "model", "value")


def celsius_training(joined: DataFrame) -> DataFrame:
    return joined.withColumn("TSOIL", kelvin_to_celsius("TSOIL"))


def within_year(df: DataFrame, year: Column) -> DataFrame:
    """A calendar year as a half-open date range."""
    first, after = F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year + 1, F.lit(1), F.lit(1))
    return df.where((F.col("datetime") >= first) & (F.col("datetime") < after))


def within_month(df: DataFrame, first: Column) -> DataFrame:
    return df.where((F.col("datetime") >= first) & (F.col("datetime") < F.add_months(first, 1)))


def fit_all(joined: DataFrame, reference: Column) -> dict[str, DataFrame]:
    """The regression models of a forecast made at ``reference``.

    ``lm`` uses all history, ``exp`` the calendar year before the training month's, ``exp_month`` that month.
    """
    return {
        "lm": fit_soil_linear(celsius_training(joined)),
        "exp": fit_soil_exponential(within_year(joined, training_year(reference))),
        "exp_month": fit_soil_exponential(within_month(joined, training_month(reference))),
    }


@dataclass(frozen=True)
class Fits:
    """What a forecast is made with: coefficients by site and model, and the trees of each site."""

    coefficients: DataFrame
    trees: DataFrame | None


def fit_forecast(targets: DataFrame, drivers: DataFrame, reference: Column, boosted_rounds: int = 200) -> Fits:
    """The models of a forecast made at ``reference``; ``boosted_rounds=0`` leaves the trees out. The joined training
    rows are settled once for all models."""
    joined = settle(pair_training_rows(targets, drivers))
    month = celsius_training(within_month(joined, training_month(reference)))
    return Fits(settle(coefficient_rows(fit_all(joined, reference))), fit_boosted(month, boosted_rounds) if boosted_rounds else None)


def predict_forecast(
    ensemble: DataFrame, fits: Fits, unc_fac: float = 1.0, noise: float = 1.0, seed: int = 0, include_null: bool = False
) -> DataFrame:
    """Every model's value for every ensemble row of its sites."""
    parts = [predict_models(ensemble, fits.coefficients, unc_fac, noise, seed).select(*VALUE_COLUMNS)]
    if fits.trees is not None:
        parts.append(predict_boosted(None, ensemble, noise=noise, seed=seed, models=fits.trees).select(*VALUE_COLUMNS))
    if include_null:
        parts.append(predict_null_model(ensemble).select(*VALUE_COLUMNS))
    return bind_rows(*parts)


def forecast_values(
    ensemble: DataFrame, targets: DataFrame, drivers: DataFrame, boosted_rounds: int = 200, reference_date: str | None = None, **noise
) -> DataFrame:
    """Every model's value for every ensemble row. ``noise`` as in ``predict_forecast``.

    ``reference_date`` is the run's first day; a caller who knows it saves a pass over the ensemble.
    """
    reference = F.lit(reference_date).cast("date") if reference_date else F.to_date(earliest(ensemble))
    return predict_forecast(ensemble, fit_forecast(targets, drivers, reference, boosted_rounds), **noise)


def daily_forecast(ensemble: DataFrame, targets: DataFrame, drivers: DataFrame, forecast_date: str, **options) -> DataFrame:
    """Summary per site and model of the forecast date, from the first day of the run."""
    values = forecast_values(first_day(ensemble), targets, drivers, **options)
    by_day = forecast_day(values.withColumn("day", day_of("datetime")), forecast_date)
    return ensemble_summary(by_day, ["site_id", "model", "day"])


def horizon_forecast(
    ensemble: DataFrame, targets: DataFrame, drivers: DataFrame, reference_date: str, **options
) -> DataFrame:
    """Summary, lead time in days and CRPS per site, model and day over the whole run, where the flux was observed."""
    options.setdefault("reference_date", reference_date)
    values = forecast_values(ensemble, targets, drivers, **options).withColumn("day", day_of("datetime"))
    observed = targets.select("site_id", F.to_date("datetime").alias("day"), "flux")
    scored = score_ensemble(
        values, ["site_id", "model", "day"], "value", observed, observation_keys=["site_id", "day"]
    )
    horizon = F.datediff("day", F.lit(reference_date).cast("date"))
    return scored.withColumn("horizon", horizon).select(*FORECAST_HORIZON.names)
