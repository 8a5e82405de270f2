"""Boosted regression trees for every site at once.

Each site has a model of its own, as a boosting library trained per site would make: second-order boosting of squared
error with an L2 term, which shrinks the leaves of few rows. A covariate is cut into at most ``BINS`` bins. Up to that
many distinct values each are a bin; beyond, values that hold a large share of the rows are bins of their own, and the
others are dealt out by their ranks. A bin is all a tree knows of a value, in training and in prediction, so rows
collapse, map-side, to the cells of a grid of bins (rows, sum and squares of the flux), and what a task holds of one site is at
most ``BINS`` x ``BINS`` cells, however many rows and values the site has.

A model is a step function of its two covariates: where its bins begin, and the value of each step, packed in one array.
The ensemble is predicted by binary searches and index arithmetic, beside the few hundred kB of its site's model.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edaflux.functions.noise import keyed_gaussian
from edaflux.functions.scalars import kelvin_to_celsius
from edaflux.operators.joins import lookup
from edaflux.operators.ranking import value_ranks
from edaflux.session import settle

MIN_ROWS = 5  # strictly more are needed
BINS = 256
SEARCH_STEPS = 8  # a binary search among up to BINS - 1 cuts
HEAVY = 64  # a value with this part of the rows is a bin of its own
DEPTH = 3
RATE = 0.1
PENALTY = 1.0  # the L2 term: rows added, with a residual of zero, to every part
TIE = 1e-9  # gains that are equal up to this part count as equal
LEAST_GAIN = 1e-6
COVARIATES = ("TSOIL", "SOILW")


def boost(rows: np.ndarray, sums: np.ndarray, rounds: int) -> np.ndarray:
    """The fitted value of each cell of a grid with ``rows`` rows and ``sums``, their responses added up.

    It starts from the mean. A round's tree splits up to ``DEPTH`` deep, each part where the gain is largest (of equal
    ones at the first covariate, and there at the smallest value), and moves each leaf by ``RATE`` times its sum of residuals
    over its rows plus ``PENALTY``.
    """
    fitted = np.full(rows.shape, sums.sum() / rows.sum())
    for _ in range(rounds):
        rest = sums - rows * fitted
        boxes = [(slice(0, rows.shape[0]), slice(0, rows.shape[1]))]
        for _ in range(DEPTH):
            boxes = [part for box in boxes for part in _split(rows, rest, box)]
        for box in boxes:
            fitted[box] += RATE * rest[box].sum() / (rows[box].sum() + PENALTY)
    return fitted


def _split(rows: np.ndarray, rest: np.ndarray, box: tuple[slice, slice]) -> list[tuple[slice, slice]]:
    """The two parts of a box with the largest gain, or the box itself where no cut gains anything."""
    weight, gain = rows[box], rest[box]
    scores = []
    for axis in range(2):
        w, g = np.cumsum(weight.sum(1 - axis)), np.cumsum(gain.sum(1 - axis))
        left, right = w[:-1], w[-1] - w[:-1]
        score = g[:-1] ** 2 / (left + PENALTY) + (g[-1] - g[:-1]) ** 2 / (right + PENALTY) - g[-1] ** 2 / (w[-1] + PENALTY)
        scores.append(np.where((left > 0) & (right > 0), score, -1.0))
    best = max(s.max(initial=-1.0) for s in scores)
    if best <= LEAST_GAIN:
        return [box]
    axis, at = next((a, int(np.argmax(s >= best - TIE * best))) for a, s in enumerate(scores) if (s >= best - TIE * best).any())
    low, high = list(box), list(box)
    cut = box[axis].start + at + 1
    low[axis], high[axis] = slice(box[axis].start, cut), slice(cut, box[axis].stop)
    return [tuple(low), tuple(high)]


def with_bin(rows: DataFrame, name: str, value: Column, cuts: Column) -> DataFrame:
    """``rows`` with the number of ``cuts`` (ascending, fewer than ``BINS``) that are not above ``value``; null for null.

    A binary search in plain expressions, each step on the column before it: generated code, without a pass over the
    array for each row.
    """
    out = rows.withColumns({name: F.when(value.isNotNull() & cuts.isNotNull(), F.lit(0)), f"{name}_x": value})
    for k in reversed(range(SEARCH_STEPS)):
        further = F.get(cuts, F.col(name) + (2**k - 1)) <= F.col(f"{name}_x")
        out = out.withColumn(name, F.col(name) + F.when(further, 2**k).otherwise(0))
    return out.drop(f"{name}_x")


def bin_starts(rows: DataFrame) -> DataFrame:
    """Rows (site_id, cuts): for each covariate the smallest value of each of its bins but the first, ascending.

    The bins are made of the site's distinct values and their exact ranks, in range partitions; nothing of a site is
    gathered but its bins.
    """
    axes = F.posexplode(F.array(*[F.col(c) for c in COVARIATES])).alias("_axis", "_x")
    ranks = value_ranks(rows.select("site_id", axes), ["site_id", "_axis"], "_x")
    heavy = F.col("copies") * HEAVY >= F.col("size")
    groups = ranks.groupBy("site_id", "_axis").agg(
        F.count("*").alias("values"), F.sort_array(F.collect_list(F.when(heavy, F.struct("_x", "copies")))).alias("heavies")
    )
    placed = ranks.join(groups, ["site_id", "_axis"])
    before = F.filter("heavies", lambda h: h["_x"] < F.col("_x"))
    weight = F.aggregate(before, F.lit(0).cast("long"), lambda a, h: a + h["copies"])
    whole = F.aggregate("heavies", F.lit(0).cast("long"), lambda a, h: a + h["copies"])
    # Each heavy value can cut a bin of light ones in two, so twice their number is left free.
    light = F.floor((F.col("below") - weight) * (BINS - 2 * F.size("heavies")) / F.greatest(F.col("size") - whole, F.lit(1)))
    own = (F.col("values") <= BINS) | heavy
    bin_ = F.struct(F.size(before).alias("h"), F.when(own, F.col("_x")).alias("own"), F.when(~own, light).alias("light"))
    starts = placed.groupBy("site_id", "_axis", bin_.alias("_bin")).agg(F.min("_x").alias("start"))
    by_axis = starts.groupBy("site_id", "_axis").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    by_axis = by_axis.select("site_id", "_axis", F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))).alias("starts"))
    return by_axis.groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("_axis", "starts"))).alias("c")).select("site_id", F.col("c.starts").alias("cuts"))


_MODEL = "site_id {kind}, sigma double, steps array<double>"


def fit_boosted(joined_celsius: DataFrame, rounds: int = 200) -> DataFrame:
    """One row per site with more than five joined rows: (site_id, sigma, cuts, steps), settled.

    ``steps`` holds the fitted values by the first covariate's bin, then the second's. The model is null where not more than
    five rows are complete in every column. ``sigma`` is the sd of the residuals. Infinite covariates count as missing.
    """
    used = [c for c in joined_celsius.columns if c != "site_id"]
    complete = F.lit(True)
    for c in used:
        complete = complete & F.col(c).isNotNull()
    for c in COVARIATES:
        complete = complete & (F.abs(F.col(c)) < float("inf"))
    rows = settle(joined_celsius.select("site_id", complete.alias("_whole"), *[F.when(complete, F.col(c)).alias(c) for c in (*COVARIATES, "flux")]))
    sites = rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MIN_ROWS).select("site_id")
    whole = rows.where("_whole").drop("_whole")
    starts = settle(bin_starts(whole))
    binned = lookup(whole, starts, ["site_id"])
    for k, c in enumerate(COVARIATES):
        binned = with_bin(binned, f"_bin{k}", F.col(c), F.col("cuts")[k])
    bins = [(F.size(F.col("cuts")[k]) + 1).alias(f"_bins{k}") for k in range(2)]
    cells = binned.groupBy("site_id", "_bin0", "_bin1", *bins).agg(
        F.count(F.lit(1)).alias("n"), F.sum("flux").alias("total"), F.sum(F.col("flux") * F.col("flux")).alias("squares"),
    )

    def train(cell: pd.DataFrame) -> pd.DataFrame:
        if cell["n"].sum() <= MIN_ROWS:
            return pd.DataFrame({"site_id": cell["site_id"].iloc[:0], "sigma": pd.Series(dtype=float), "steps": pd.Series(dtype=object)})
        at = (cell["_bin0"].to_numpy(), cell["_bin1"].to_numpy())
        n, total, squares = (np.zeros(cell[["_bins0", "_bins1"]].iloc[0]) for _ in range(3))
        n[at], total[at], squares[at] = cell["n"], cell["total"], cell["squares"]
        own = boost(n, total, rounds)
        # sd about the residuals' own mean, from sums over cells
        rest = (total - n * own).sum()
        spread = (squares - 2 * own * total + n * own * own).sum()
        sigma = np.sqrt(max(spread - rest * rest / n.sum(), 0) / (n.sum() - 1))
        return pd.DataFrame({"site_id": cell["site_id"].iloc[:1], "sigma": [sigma], "steps": [own.ravel()]})

    kind = joined_celsius.schema["site_id"].dataType.simpleString()
    models = cells.groupBy("site_id").applyInPandas(train, _MODEL.format(kind=kind))
    return settle(sites.select("site_id").join(starts.join(models, "site_id"), "site_id", "left").select("site_id", "sigma", "cuts", "steps"))


def predict_boosted(
    joined_celsius: DataFrame | None, ensemble: DataFrame, rounds: int = 200, noise: float = 1.0, seed: int = 0,
    models: DataFrame | None = None,
) -> DataFrame:
    """``value`` of model ``xgboost`` for every ensemble row of a site with more than five joined rows.

    A site with too few rows complete in every column gets null, as does a row without a covariate. One residual is drawn
    per site, not per row. Temperatures are Celsius in training and in prediction. ``models`` saves the fit where it was
    made already.
    """
    models = fit_boosted(joined_celsius, rounds) if models is None else models
    rows = lookup(ensemble, models, ["site_id"])
    for k, x in enumerate((kelvin_to_celsius("TSOIL"), F.col("SOILW"))):
        rows = with_bin(rows, f"_bin{k}", x, F.col("cuts")[k])
    value = F.get("steps", F.col("_bin0") * (F.size(F.col("cuts")[1]) + 1) + F.col("_bin1"))
    if noise:
        value = value + F.lit(float(noise)) * F.col("sigma") * keyed_gaussian(seed, "boosted", ["site_id"])
    return rows.select(*ensemble.columns, value.alias("value"), F.lit("xgboost").alias("model"))
