"""Predictions over an ensemble: coefficients in, one value per row and model out."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edaflux.functions.noise import keyed_gaussian
from edaflux.functions.scalars import kelvin_to_celsius, null_model_flux, reduced_temperature_kelvin
from edaflux.operators.joins import attach_coefficients
from edaflux.operators.reshape import bind_rows

ROW_KEYS = ("site_id", "model", "reference_datetime", "ensemble", "datetime")
# Coefficient columns shared by all models; a model leaves null what it has no use for.
COEFFICIENTS = (
    "intercept", "b_soilw", "b_tsoil", "b_t10", "se_intercept", "se_soilw", "se_tsoil", "se_t10", "sigma",
)


def model_rows(fit: DataFrame, model: str) -> DataFrame:
    """A fit as rows of the shared coefficient table."""
    have = set(fit.columns)
    cols = [F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in COEFFICIENTS]
    return fit.select("site_id", F.lit(model).alias("model"), *cols)


def coefficient_rows(fits: Mapping[str, DataFrame]) -> DataFrame:
    """Every site and model in one table, so an ensemble is joined and read once for all of them."""
    return bind_rows(*[model_rows(fit, model) for model, fit in fits.items()])


def predict_models(
    ensemble: DataFrame, coefficients: DataFrame, unc_fac: float = 1.0, noise: float = 1.0, seed: int = 0
) -> DataFrame:
    """``value`` for every ensemble row and every model fitted at its site.

    Each row draws its own coefficients, normal around the estimates with ``unc_fac`` standard errors and independent
    across terms, and its own residual with ``noise`` times sigma. Exponential models return to the flux scale last.
    With both factors zero the prediction is the fitted surface.
    """
    joined = attach_coefficients(ensemble, coefficients)

    def draw(tag: str, scale: Column, factor: float) -> Column:
        if factor == 0:
            return F.lit(0.0)
        return F.lit(float(factor)) * scale * keyed_gaussian(seed, tag, ROW_KEYS)

    def term(name: str) -> Column:
        return F.col(f"b_{name}") + draw(name, F.col(f"se_{name}"), unc_fac)

    intercept = F.col("intercept") + draw("intercept", F.col("se_intercept"), unc_fac)
    residual = draw("process", F.col("sigma"), noise)
    linear = intercept + term("soilw") * F.col("SOILW") + term("tsoil") * kelvin_to_celsius("TSOIL") + residual
    power = F.exp(intercept + term("t10") * reduced_temperature_kelvin("TSOIL") + residual)
    value = F.when(F.col("model") == "lm", linear).otherwise(power)
    return joined.withColumn("value", value).drop(*COEFFICIENTS)


def predict_null_model(ensemble: DataFrame) -> DataFrame:
    return ensemble.withColumns({"model": F.lit("null"), "value": null_model_flux("TSOIL")})


STANDARD_COLUMNS = ("parameter", "datetime", "family", "site_id", "reference_datetime", "prediction", "variable")


def standard_prediction(ensemble: DataFrame, prediction: Column, variable: str) -> DataFrame:
    """A deterministic prediction in the standard columns."""
    named = ensemble if "parameter" in ensemble.columns else ensemble.withColumnRenamed("ensemble", "parameter")
    return named.withColumns({"prediction": prediction, "variable": F.lit(variable)}).select(*STANDARD_COLUMNS)


def apply_model(
    drivers: DataFrame,
    model_fn: Callable[..., Column],
    uncertainty: bool = False,
    process_unc: float = 0.0,
    seed: int = 0,
    keys: Sequence[str] = ("site_id", "reference_datetime", "parameter", "datetime"),
) -> DataFrame:
    """A user's model: a function from driver columns, matched by argument name, to a Column.

    It may also take ``uncertainty``. Process noise with sd ``process_unc`` is added per row.
    """
    wanted = inspect.signature(model_fn).parameters
    args: dict[str, object] = {c: F.col(c) for c in drivers.columns if c in wanted}
    if "uncertainty" in wanted:
        args["uncertainty"] = uncertainty
    prediction = model_fn(**args)
    if process_unc:
        prediction = prediction + F.lit(float(process_unc)) * keyed_gaussian(seed, "process", keys)
    return drivers.withColumn("prediction", prediction)
