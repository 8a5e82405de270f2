"""Non-linear least squares for every site at once (damped Gauss-Newton).

The data stay distributed. Each iteration is one aggregate over the training rows: the normal equations and the squared
error of every group a whole step on. Only groups whose error rose there are tried at a ladder of shorter steps. The parameter table (one row
per group) is settled between iterations, so neither the driver nor the lineage grows with groups or iterations.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edaflux.functions.slopes import NoSlope, slopes
from edaflux.session import broadcast_if_small, settle

STEP_HALVINGS = 10
# Residuals below this share of the response (as sums of squares) are rounding: the curve passes through the data.
EXACT_FIT = 1e-20
RELATIVE_STEP = 1e-6


def fit_formula(
    df: DataFrame, keys: Sequence[str], response: str, formula: str, parameters: Sequence[str],
    start: Mapping[str, float] | None = None, max_iterations: int = 50, tolerance: float = 1e-5,
) -> DataFrame:
    """Fit ``response ~ formula`` per group; ``formula`` is a SQL expression over columns and parameter names.

    Parameters without a start value begin at 1. A group has converged once the part of its residuals the parameters
    could still explain is at most ``tolerance`` times the rest. Returns keys, one column per parameter, ssr, n,
    iterations and status; a group that does not converge, or whose formula yields no number, has null parameters and
    says so.
    """
    keys, names = list(keys), list(parameters)
    begin = {p: float((start or {}).get(p, 1.0)) for p in names}
    used = [c for c in df.columns if c in keys or c == response or re.search(rf"\b{re.escape(c)}\b", formula)]
    data = settle(df.select(*used).dropna("any"))

    was, step = ([f"{mark}{p}" for p in names] for mark in ("_was_", "_step_"))
    state = settle(data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.lit(begin[p]).alias(p) for p in names],
    ).withColumns({
        "ssr": F.lit(None).cast("double"), "iterations": F.lit(0), "status": F.lit("running"),
        **{c: F.lit(None).cast("double") for c in (*was, *step)},
    }))

    # A running group stands at a whole step from where it was. ``ssr`` is the error there, null at the start.
    for _ in range(max_iterations):
        active = state.where(F.col("status") == "running")
        if active.isEmpty():
            break
        stepped = _steps(data, active.select(*keys, *names), keys, response, formula, names)
        failed = active.join(stepped.select(*keys, "_sse"), keys)
        failed = settle(failed.where("ssr IS NOT NULL AND NOT coalesce(_sse < ssr, false)").drop("_sse"))
        rest = state.where(F.col("status") != "running")
        if not failed.isEmpty():
            failed = _shortened(data, failed, keys, response, formula, names, STEP_HALVINGS)
            back = failed.where(F.col("status") == "running").select(*keys, *names)
            again = _steps(data, back, keys, response, formula, names)
            stepped = stepped.join(failed.select(*keys), keys, "left_anti").unionByName(again)
            rest = rest.unionByName(failed.where(F.col("status") != "running"))
        exact = F.col("_ssr0") <= F.lit(EXACT_FIT) * F.col("_yy")
        done = exact | (F.col("_gain") <= F.lit(tolerance**2) * (F.col("_ssr0") - F.col("_gain")))
        status = (
            F.when(F.col("_ssr0").isNull(), "undefined")
            .when(done, "converged")
            .when(F.col("_gain").isNull(), "singular")
            .otherwise("running")
        )
        # The last step of a converged group is taken too: it is short, and halves the digits that are still wrong.
        moved = active.select(*keys, "n", "iterations").join(stepped, keys).select(
            *keys, "n", *[(F.col(p) + F.coalesce(f"_d_{p}", F.lit(0.0))).alias(p) for p in names],
            F.col("_ssr0").alias("ssr"), (F.col("iterations") + 1).alias("iterations"), status.alias("status"),
            *[F.col(p).alias(w) for p, w in zip(names, was, strict=True)],
            *[F.col(f"_d_{p}").alias(d) for p, d in zip(names, step, strict=True)],
        )
        state = settle(rest.unionByName(moved))

    last = state.where(F.col("status") == "running")
    if not last.isEmpty():
        last = _shortened(data, last, keys, response, formula, names, STEP_HALVINGS, first=0)
        state = state.where(F.col("status") != "running").unionByName(last)
    done = F.col("status") == "converged"
    return state.select(
        *keys, *[F.when(done, F.col(p)).alias(p) for p in names], F.when(done, F.col("ssr")).alias("ssr"), "n", "iterations",
        F.when(F.col("status") == "running", "iteration limit").otherwise(F.col("status")).alias("status"),
    )


def _substituted(formula: str, names: Sequence[str], with_text: Mapping[str, str]) -> str:
    pattern = r"\b(" + "|".join(re.escape(n) for n in names) + r")\b"
    return re.sub(pattern, lambda m: with_text.get(m.group(1), m.group(1)), formula)


def _finite(expression: str):
    """The expression's value where it is a finite number."""
    value = F.expr(f"try_divide(cast({expression} as double), 1.0D)")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def _slopes(spark: SparkSession, formula: str, names: Sequence[str]) -> dict[str, Column]:
    """Columns with the slope of each parameter: by the chain rule, or by differences where it has no rule for the formula."""
    try:
        return {p: _finite(d) for p, d in slopes(spark, formula, names).items()}
    except NoSlope:
        out = {}
        for p in names:
            h = f"(greatest(abs({p}), 1D) * {RELATIVE_STEP!r}D)"
            up, down = (_finite(_substituted(formula, names, {p: f"({p} {sign} {h})"})) for sign in "+-")
            out[p] = (up - down) / F.expr(f"2D * {h}")
        return out


def _steps(data, params, keys, response, formula, names) -> DataFrame:
    """Each group's Gauss-Newton step from J'J and J'r, its squared error (``_ssr0``; ``_sse`` where slopes need not be
    finite), and how much of that the step explains."""
    joined = data.join(broadcast_if_small(params), keys)
    found = {f"_j_{p}": d for p, d in _slopes(data.sparkSession, formula, names).items()}
    rows = joined.withColumns({"_r": F.col(response) - _finite(formula), **found})
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    # A row without a finite value or slope makes the group's sums null: its fit is undefined.
    whole = F.count(F.lit(1)) == F.count(F.col("_r") + sum((F.col(f"_j_{p}") for p in names), F.lit(0.0)))
    sums = rows.groupBy(*keys).agg(
        F.when(whole, F.array(*[F.sum(F.col(f"_j_{a}") * F.col(f"_j_{b}")) for a, b in pairs])).alias("jj"),
        F.when(whole, F.array(*[F.sum(F.col(f"_j_{p}") * F.col("_r")) for p in names])).alias("jr"),
        F.when(whole, F.sum(F.col("_r") * F.col("_r"))).alias("_ssr0"),
        F.when(F.count("_r") == F.count(F.lit(1)), F.sum(F.col("_r") * F.col("_r"))).alias("_sse"),
        F.sum(F.col(response) * F.col(response)).alias("_yy"),
    )
    k, columns = len(names), [*[f"_d_{p}" for p in names], "_gain"]

    def solve(batches):
        for pdf in batches:
            steps = np.full((len(pdf), k + 1), np.nan)
            known = pdf["jj"].notna().to_numpy()
            if known.any():
                steps[known] = stacked_steps(np.array(pdf["jj"][known].tolist(), float), np.array(pdf["jr"][known].tolist(), float))
            out = pdf[[*keys, "_ssr0", "_sse", "_yy"]].copy()
            for i, name in enumerate(columns):
                out[name] = pd.Series(steps[:, i], index=pdf.index).astype("object").where(~np.isnan(steps[:, i]), None)
            yield out

    schema = T.StructType([
        *[sums.schema[c] for c in keys], *[T.StructField(c, T.DoubleType()) for c in ("_ssr0", "_sse", "_yy")],
        *[T.StructField(c, T.DoubleType()) for c in columns],
    ])
    return settle(params.join(sums.mapInPandas(solve, schema), keys))


def stacked_steps(jj: np.ndarray, jr: np.ndarray) -> np.ndarray:
    """Steps of a stack of normal equations, given as upper triangles, and what each explains of the squared error; not a
    number where a system is singular."""
    k = jr.shape[1]
    a = np.zeros((len(jr), k, k))
    upper = np.triu_indices(k)
    a[:, upper[0], upper[1]] = jj
    a[:, upper[1], upper[0]] = jj
    scale = np.sqrt(np.diagonal(a, axis1=1, axis2=2))
    good = (scale > 0).all(1) & np.isfinite(a).all((1, 2)) & np.isfinite(jr).all(1)
    scale = np.where(good[:, None], scale, 1.0)
    system = np.where(good[:, None, None], a / (scale[:, :, None] * scale[:, None, :]), np.eye(k))
    good &= np.linalg.det(system) > 1e-14
    steps = np.linalg.solve(np.where(good[:, None, None], system, np.eye(k)), (jr / scale)[..., None])[..., 0] / scale
    return np.where(good[:, None], np.column_stack([steps, np.maximum((steps * jr).sum(1), 0.0)]), np.nan)


def _shortened(data, failed, keys, response, formula, names, halvings, first=1) -> DataFrame:
    """Groups of the state at the longest of their shorter steps that lowers the squared error; without one they are where
    they were, and their status says so. Only rows of these groups are read."""
    at = failed.select(
        *keys, F.col("ssr").alias("_ssr0"), *[F.col(f"_was_{p}").alias(p) for p in names],
        *[F.col(f"_step_{p}").alias(f"_d_{p}") for p in names],
    )
    best = _best_lengths(data, at, keys, response, formula, names, [0.5**i for i in range(first, halvings + 1)])
    found = failed.join(best, keys, "left")
    place = {p: F.col(f"_was_{p}") + F.coalesce("_length", F.lit(0.0)) * F.col(f"_step_{p}") for p in names}
    status = F.when(F.col("_length").isNull(), "no descent").otherwise(F.col("status"))
    return settle(found.withColumns({**place, "status": status}).select(*failed.columns))


def _best_lengths(data, stepped, keys, response, formula, names, lengths) -> DataFrame:
    """The first of ``lengths`` whose step lowers each group's squared error, all tried in one pass."""
    joined = data.join(broadcast_if_small(stepped), keys)
    errors = []
    for length in lengths:
        moved = _substituted(formula, names, {p: f"({p} + {length!r}D * _d_{p})" for p in names})
        r = F.col(response) - _finite(moved)
        errors.append(F.when(F.count(r) == F.count(F.lit(1)), F.sum(r * r)))
    tried = joined.groupBy(*keys).agg(F.array(*errors).alias("_errors"))
    ladder = F.array(*[
        F.struct(F.lit(length).alias("length"), F.col("_errors")[i].alias("ssr")) for i, length in enumerate(lengths)
    ])
    better = F.get(F.filter(ladder, lambda s: s["ssr"] < F.col("_ssr0")), F.lit(0))
    return stepped.join(tried, keys).select(*keys, better["length"].alias("_length"), better["ssr"].alias("_ssr"))
