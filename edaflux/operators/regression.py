"""Least-squares fits for all groups at once, from centred moments that combine map-side.

One row of moments per group leaves the first stage, however many observations the group holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edaflux.functions.pvalues import f_one_upper, t_two_sided
from edaflux.functions.scalars import log_flux, reduced_temperature, reduced_temperature_kelvin
from edaflux.operators.filters import complete_cases, usable_log_rows

# A covariate whose spread is less than this part of its squares is constant.
RANK_TOLERANCE = 1e-14
# A covariate is aliased, and its term null, if those before it leave less than this part of its spread. Sums of products
# hold half the digits of the data, and the rounding of large groups lies below this bound.
ALIAS_TOLERANCE = 1e-12


def _centred(n: Column, a: str, b: str) -> Column:
    """Sum of cross products about the means."""
    return n * F.covar_pop(a, b)


def fit_line(
    df: DataFrame, keys: Sequence[str], y: str, x: str, more_than: int = 0, keep_groups: bool = False
) -> DataFrame:
    """y on one covariate, per group, over the rows that have both.

    Columns: n, intercept, slope, se_intercept, se_slope, sigma (sd of residuals over n-1), ssr, syy.
    A constant covariate or too few rows gives null terms. Groups of at most ``more_than`` rows are dropped, or with
    ``keep_groups`` stay with null terms.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    n, xs, ys = F.count_if(both), F.when(both, F.col(x)), F.when(both, F.col(y))
    centred = lambda a, b: n * F.covar_pop(a, b)
    moments = df.groupBy(*keys).agg(
        n.alias("n"), F.avg(xs).alias("_mx"), F.avg(ys).alias("_my"),
        centred(xs, xs).alias("_sxx"), centred(xs, ys).alias("_sxy"), centred(ys, ys).alias("syy"),
    )
    enough = F.col("n") > more_than
    if not keep_groups:
        moments = moments.where(enough)
    # A covariate whose spread is rounding beside its size is constant.
    floor = F.lit(RANK_TOLERANCE) * (F.col("_sxx") + F.col("n") * F.col("_mx") * F.col("_mx"))
    slope = F.try_divide(F.col("_sxy"), F.when(enough & (F.col("_sxx") > floor), F.col("_sxx")))
    solved = moments.withColumn("slope", slope).withColumn(
        "ssr", F.greatest(F.col("syy") - F.col("slope") * F.col("_sxy"), F.when(F.col("slope").isNotNull(), 0.0))
    )
    s2 = F.when(F.col("n") > 2, F.col("ssr") / (F.col("n") - 2))
    return solved.select(
        *keys, "n",
        (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), "slope",
        F.sqrt(s2 * (F.lit(1.0) / F.col("n") + F.try_divide(F.col("_mx") * F.col("_mx"), F.col("_sxx"))))
        .alias("se_intercept"),
        F.sqrt(F.try_divide(s2, F.col("_sxx"))).alias("se_slope"),
        F.when(F.col("n") > 1, F.sqrt(F.try_divide(F.col("ssr"), (F.col("n") - 1).cast("double")))).alias("sigma"),
        "ssr", "syy",
    )


def fit_plane(df: DataFrame, keys: Sequence[str], y: str, x1: str, x2: str, more_than: int = 0) -> DataFrame:
    """y on two covariates, per group; columns as ``fit_line`` with slope1, slope2 and their errors.

    A constant covariate, and a second one collinear with the first, are aliased: their terms are null and the others are
    those of the fit without them. ``rank`` counts the terms that are left.
    """
    n = F.count(F.lit(1))
    m = df.groupBy(*keys).agg(
        n.alias("n"), F.avg(x1).alias("_m1"), F.avg(x2).alias("_m2"), F.avg(y).alias("_my"),
        _centred(n, x1, x1).alias("_s11"), _centred(n, x2, x2).alias("_s22"), _centred(n, x1, x2).alias("_s12"),
        _centred(n, x1, y).alias("_s1y"), _centred(n, x2, y).alias("_s2y"), _centred(n, y, y).alias("syy"),
    ).where(F.col("n") > more_than)
    c = F.col
    floor = F.lit(RANK_TOLERANCE)

    def varies(k: int) -> Column:
        return c(f"_s{k}{k}") > floor * (c(f"_s{k}{k}") + c("n") * c(f"_m{k}") * c(f"_m{k}"))

    det = c("_s11") * c("_s22") - c("_s12") * c("_s12")
    both = varies(1) & varies(2) & (c("n") > 2) & (det > F.lit(ALIAS_TOLERANCE) * c("_s11") * c("_s22"))
    one = varies(1) & (c("n") > 1)
    m = m.withColumns({"_det": F.when(both, det), "_one": one, "_two": F.when(one, both).otherwise(varies(2) & (c("n") > 1))})
    two = c("_det").isNotNull()
    slope1 = F.when(two, (c("_s22") * c("_s1y") - c("_s12") * c("_s2y")) / c("_det")).when(c("_one"), c("_s1y") / c("_s11"))
    slope2 = F.when(two, (c("_s11") * c("_s2y") - c("_s12") * c("_s1y")) / c("_det")).when(c("_two"), c("_s2y") / c("_s22"))
    m = m.withColumns({"slope1": slope1, "slope2": slope2, "rank": 1 + c("_one").cast("int") + c("_two").cast("int")})
    part1, part2 = (F.coalesce(c(f"slope{k}"), F.lit(0.0)) for k in (1, 2))
    m = m.withColumn("ssr", F.greatest(c("syy") - part1 * c("_s1y") - part2 * c("_s2y"), F.lit(0.0)))
    s2 = F.when(c("n") > c("rank"), c("ssr") / (c("n") - c("rank")))
    spread = F.when(
        two, (c("_m1") * c("_m1") * c("_s22") - F.lit(2.0) * c("_m1") * c("_m2") * c("_s12") + c("_m2") * c("_m2") * c("_s11")) / c("_det")
    ).when(c("_one"), c("_m1") * c("_m1") / c("_s11")).when(c("_two"), c("_m2") * c("_m2") / c("_s22")).otherwise(0.0)
    return m.select(
        *keys, "n",
        (c("_my") - part1 * c("_m1") - part2 * c("_m2")).alias("intercept"), "slope1", "slope2",
        F.sqrt(s2 * (F.lit(1.0) / c("n") + spread)).alias("se_intercept"),
        F.sqrt(F.when(two, s2 * c("_s22") / c("_det")).when(c("_one"), s2 / c("_s11"))).alias("se_slope1"),
        F.sqrt(F.when(two, s2 * c("_s11") / c("_det")).when(c("_two"), s2 / c("_s22"))).alias("se_slope2"),
        F.when(c("n") > 1, F.sqrt(F.try_divide(c("ssr"), (c("n") - 1).cast("double")))).alias("sigma"),
        "ssr", "syy", "rank",
    )


def fit_soil_linear(joined_celsius: DataFrame) -> DataFrame:
    """``lm``: flux on SOILW and TSOIL (Celsius) by site, over rows complete in every joined column."""
    fit = fit_plane(complete_cases(joined_celsius), ["site_id"], "flux", "SOILW", "TSOIL").drop("rank")
    return fit.withColumnsRenamed(
        {"slope1": "b_soilw", "slope2": "b_tsoil", "se_slope1": "se_soilw", "se_slope2": "se_tsoil"}
    )


def fit_soil_exponential(joined_kelvin: DataFrame) -> DataFrame:
    """``exp`` and ``exp_month``: ln(flux) on reduced temperature by site, more than two usable rows."""
    rows = usable_log_rows(joined_kelvin.withColumn("TSOIL10", reduced_temperature_kelvin("TSOIL")))
    fit = fit_line(rows.withColumn("ln_flux", log_flux("flux")), ["site_id"], "ln_flux", "TSOIL10", more_than=2)
    return fit.withColumnsRenamed({"slope": "b_t10", "se_slope": "se_t10"})


def fit_q10(rows_celsius: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q10 law: terms ``kR`` and ``Q10`` per group; groups of at most three usable rows get null values."""
    keys = list(keys)
    logs = rows_celsius.withColumns({"ln_flux": log_flux("flux"), "T10": reduced_temperature("TSOIL")})
    finite = [F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).alias(c) for c in ("ln_flux", "T10")]
    out = fit_line(logs.select(*keys, *finite), keys, "ln_flux", "T10", more_than=3, keep_groups=True)
    terms = [("kR", "intercept"), ("Q10", "slope")]
    pairs = [F.struct(F.lit(t).alias("term"), F.exp(F.col(c)).alias("value")) for t, c in terms]
    return out.select(*keys, F.inline(F.array(*pairs)))


def coefficient_table(fit: DataFrame, keys: Sequence[str], terms: dict[str, tuple[str, str]], parameters: int) -> DataFrame:
    """Tidy rows: term, estimate, std_error, statistic, p_value. ``terms`` maps a term to its two columns."""
    rows = [
        F.struct(F.lit(t).alias("term"), F.col(b).alias("estimate"), F.col(se).alias("std_error"))
        for t, (b, se) in terms.items()
    ]
    long = fit.select(*keys, "n", F.inline(F.array(*rows)))
    long = long.withColumn("statistic", F.try_divide(F.col("estimate"), F.col("std_error")))
    return long.withColumn("p_value", t_two_sided(F.col("statistic"), F.col("n") - parameters)).drop("n")


def training_rmse(fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Root mean squared residual straight from the moments."""
    return fit.select(*keys, "n", F.sqrt(F.try_divide(F.col("ssr"), F.col("n").cast("double"))).alias("rmse"))


def regression_diagnostics(df: DataFrame, keys: Sequence[str], y: str = "q0500", x: str = "flux") -> DataFrame:
    """Fit statistics of forecast on observation per group; all null for groups of at most two complete rows.

    A perfect fit has no finite F statistic or likelihood and leaves those null.
    """
    keys = list(keys)
    numbers = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in (y, x)]
    fit = fit_line(df.select(*keys, *numbers), keys, y, x, more_than=2, keep_groups=True)
    n, ssr, syy = F.col("n"), F.col("ssr"), F.col("syy")
    left = F.when(n > 2, n - 2).cast("double")
    some = F.when(ssr > 0, ssr)
    r2 = F.lit(1.0) - F.try_divide(ssr, syy)
    loglik = -(n / 2) * (F.ln(F.lit(2.0) * F.pi()) + F.ln(some / n) + F.lit(1.0))
    f = F.try_divide(syy - ssr, F.try_divide(some, left))
    stats = {
        "r_squared": r2, "adj_r_squared": F.lit(1.0) - (F.lit(1.0) - r2) * (n - 1) / left, "sigma": F.sqrt(ssr / left),
        "statistic": f, "p_value": f_one_upper(f, n - 2), "df": F.lit(1.0), "loglik": loglik, "aic": F.lit(6.0) - 2 * loglik,
        "bic": F.lit(3.0) * F.ln(n) - 2 * loglik, "deviance": ssr, "df_residual": n - 2, "nobs": n,
    }
    fitted = F.col("slope").isNotNull()
    return fit.select(*keys, *[F.when(fitted, c).alias(name) for name, c in stats.items()], "slope")


def fit_many(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """y on any number of covariates: tidy rows term, estimate, std_error, plus n, sigma and ssr.

    One aggregate per group collects the Gram matrix of centred columns; the small solves then run in batches, many
    groups at a time. A covariate that is constant, or collinear with those before it, is aliased: its term is null and
    the others are those of the fit without it.
    """
    keys, cols = list(keys), [*xs, y]
    n = F.count(F.lit(1))
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    moments = complete_cases(df.select(*keys, *cols)).groupBy(*keys).agg(
        n.alias("n"),
        F.array(*[F.avg(c) for c in cols]).alias("means"),
        F.array(*[_centred(n, cols[i], cols[j]) for i, j in pairs]).alias("gram"),
    )
    terms = ["(Intercept)", *xs]
    k = len(xs)

    def solve(batches):
        for pdf in batches:
            gram, means = (np.array(pdf[c].tolist(), float).reshape(len(pdf), -1) for c in ("gram", "means"))
            out = _solve_grams(gram, means, pdf["n"].to_numpy(float), pairs, k)
            for name, part in zip(("est", "se", "sigma", "ssr"), out, strict=True):
                pdf[name] = pd.Series([None if v is None else v for v in part], index=pdf.index, dtype="object")
            yield pdf.drop(columns=["gram", "means"])

    schema = T.StructType([
        *[moments.schema[c] for c in keys], moments.schema["n"],
        T.StructField("est", T.ArrayType(T.DoubleType())), T.StructField("se", T.ArrayType(T.DoubleType())),
        T.StructField("sigma", T.DoubleType()), T.StructField("ssr", T.DoubleType()),
    ])
    solved = moments.mapInPandas(solve, schema)
    rows = [
        F.struct(F.lit(t).alias("term"), F.col("est")[i].alias("estimate"), F.col("se")[i].alias("std_error"))
        for i, t in enumerate(terms)
    ]
    return solved.select(*keys, "n", "sigma", "ssr", F.inline(F.array(*rows)))


def _solve_grams(gram: np.ndarray, means: np.ndarray, n: np.ndarray, pairs: list, k: int) -> tuple[list, list, list, list]:
    """Coefficients and errors of many groups from their centred Gram matrices, swept as one stack; nulls as None.

    Covariates are swept in order. One that those before it leave nothing of is passed over, in its own groups only.
    """
    s = np.zeros((len(n), k + 1, k + 1))
    for column, (i, j) in enumerate(pairs):
        s[:, i, j] = s[:, j, i] = gram[:, column]
    my, mx = means[:, k], means[:, :k]
    spread = np.diagonal(s, axis1=1, axis2=2).copy()
    varies = spread[:, :k] > RANK_TOLERANCE * (spread[:, :k] + n[:, None] * mx**2)
    scale = np.sqrt(np.where(spread > 0, spread, 1.0))
    s /= scale[:, :, None] * scale[:, None, :]
    used = np.zeros((len(n), k), bool)
    for j in range(k):
        used[:, j] = take = varies[:, j] & (s[:, j, j] > ALIAS_TOLERANCE) & (used.sum(1) + 1 < n)
        pivot = np.where(take, s[:, j, j], 1.0)
        column = s[:, :, j].copy()
        swept = s - column[:, :, None] * column[:, None, :] / pivot[:, None, None]
        swept[:, :, j] = swept[:, j, :] = column / pivot[:, None]
        swept[:, j, j] = -1.0 / pivot
        s[take] = swept[take]
    s *= np.where(np.eye(k + 1, dtype=bool)[k], scale[:, k, None], 1 / scale)[:, :, None]
    s *= np.where(np.eye(k + 1, dtype=bool)[k], scale[:, k, None], 1 / scale)[:, None, :]
    inverse = np.where(used[:, :, None] & used[:, None, :], -s[:, :k, :k], 0.0)
    b = np.where(used, s[:, :k, k], 0.0)
    ssr = np.maximum(s[:, k, k], 0.0)
    left = n - used.sum(1) - 1
    s2 = np.where(left > 0, ssr / np.maximum(left, 1), np.nan)
    first = 1.0 / np.maximum(n, 1) + np.einsum("gi,gij,gj->g", mx, inverse, mx)
    se = np.sqrt(s2[:, None] * np.column_stack([first, np.diagonal(inverse, axis1=1, axis2=2)]))
    est = np.column_stack([my - np.einsum("gi,gi->g", b, mx), b])
    known = np.column_stack([np.ones(len(n), bool), used])

    def listed(values: np.ndarray, given: np.ndarray) -> list:
        return [[v if ok else None for v, ok in zip(row, g, strict=True)] for row, g in zip(values.tolist(), given.tolist(), strict=True)]

    sigma = np.sqrt(ssr / np.maximum(n - 1, 1))
    return listed(est, known), listed(se, known & (left > 0)[:, None]), [v if m > 1 else None for v, m in zip(sigma.tolist(), n, strict=True)], ssr.tolist()


def fit_wide(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], more_than: int = 0) -> DataFrame:
    """``fit_many`` as one row per group: n, intercept, and a column ``b_<covariate>`` each."""
    tidy = fit_many(df, keys, y, xs).where(F.col("n") > more_than)
    pick = lambda term, name: F.max(F.when(F.col("term") == term, F.col("estimate"))).alias(name)
    return tidy.groupBy(*keys).agg(F.max("n").alias("n"), pick("(Intercept)", "intercept"), *[pick(x, f"b_{x}") for x in xs])


def linear_prediction(xs: Sequence[str]) -> Column:
    """The fitted surface over the columns of ``fit_wide``; an aliased term adds nothing."""
    value = F.col("intercept")
    for x in xs:
        value = value + F.coalesce(f"b_{x}", F.lit(0.0)) * F.col(x)
    return value
