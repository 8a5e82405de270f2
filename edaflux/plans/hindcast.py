"""Hindcast evaluation and the forecast cycle."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edaflux.functions.dates import day_of, next_evaluation
from edaflux.operators.aggregate import ensemble_summary
from edaflux.operators.evaluate import coverage, score_ensemble, with_absolute_error
from edaflux.operators.joins import attach_coefficients, next_observation, pair_training_rows
from edaflux.operators.predict import apply_model
from edaflux.operators.nonlinear import fit_formula
from edaflux.operators.regression import fit_wide, linear_prediction
from edaflux.functions.scalars import within
from edaflux.session import settle
from edaflux.sources.ensemble import previous_run


MIN_ROWS = 5  # strictly more are needed for a fit


def fit_flux(
    training: DataFrame, covariates: Sequence[str] = ("SOILW", "TSOIL"), formula: str | None = None,
    parameters: Sequence[str] = (), start: Mapping[str, float] | None = None, tolerance: float = 1e-5,
) -> tuple[DataFrame, Column]:
    """Coefficients by site, and the prediction over them and the drivers.

    The model is linear in any number of drivers, or ``formula``, a SQL expression of drivers and ``parameters``. Sites
    of at most five rows complete in flux and drivers have none.
    """
    rows = training.select("site_id", "flux", *covariates).dropna()
    if formula is None:
        fit = fit_wide(rows, ["site_id"], "flux", covariates, more_than=MIN_ROWS)
        return fit.drop("n"), linear_prediction(covariates)
    fit = fit_formula(rows, ["site_id"], "flux", formula, parameters, start, tolerance=tolerance).where(F.col("n") > MIN_ROWS)
    return fit.select("site_id", *parameters), F.expr(formula)


def with_fitted(training: DataFrame, fit: DataFrame, prediction: Column) -> DataFrame:
    """The training rows of fitted sites with ``fitted`` and ``residual``."""
    out = attach_coefficients(training, fit).withColumn("fitted", prediction)
    return out.select(*training.columns, "fitted", (F.col("flux") - F.col("fitted")).alias("residual"))


def hindcast(
    training_targets: DataFrame, training_drivers: DataFrame, ensemble: DataFrame, evaluation_targets: DataFrame,
    covariates: Sequence[str] = ("SOILW", "TSOIL"), **model: object,
) -> DataFrame:
    """Fit flux on the drivers by site, predict the ensemble, score each observed day. ``model`` as in ``fit_flux``.

    ``within_80`` tells whether the observation lies between the 10% and 90% quantiles.
    """
    joined = pair_training_rows(training_targets, training_drivers)
    fit, prediction = fit_flux(joined, list(covariates), **model)
    rows = attach_coefficients(ensemble, fit)
    members = rows.select("site_id", day_of("datetime").alias("datetime"), prediction.alias("prediction"))
    scored = score_ensemble(members, ["site_id", "datetime"], "prediction", evaluation_targets)
    return scored.withColumn("within_80", within("flux", "q0100", "q0900"))


def forecast_cycle(
    observations: DataFrame, ensemble_long: DataFrame, model_fn: Callable[..., Column], met_vars: Sequence[str],
    parameter_unc: bool = False, process_unc: float = 0.0, seed: int = 0,
) -> DataFrame:
    """From every observation, forecast the next one with the run of the day before, and score it.

    All sites and dates go through one plan: runs are matched to observations by (site, reference date), members are
    summarised at the evaluation time, and each summary meets the observation made then.
    """
    known = settle(observations.where(F.col("observation").isNotNull()))
    origins = known.select("site_id", "variable", F.col("datetime").alias("origin"), "duration")
    runs = previous_run(ensemble_long, origins, met_vars).withColumnRenamed("ensemble", "parameter")
    predicted = apply_model(runs, model_fn, parameter_unc, process_unc, seed)
    at_check = predicted.withColumn("next_eval", next_evaluation("origin", "duration")).where(
        F.col("datetime") == F.col("next_eval").cast("timestamp")
    )
    summary = ensemble_summary(at_check, ["site_id", "origin", "duration", "next_eval"], "prediction")
    forecasts = summary.join(origins, ["site_id", "origin", "duration"]).drop("origin", "duration")
    scored = with_absolute_error(next_observation(forecasts, known))
    return scored.withColumnRenamed("next_eval", "datetime")


def cycle_reliability(scored: DataFrame) -> DataFrame:
    """Percent of observations inside the 95% interval, by site."""
    return coverage(scored, ["site_id"], "observation", scale=100.0)
