"""Weighted means, gap filling, daily totals and profiles."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from compare import settings

from edaflux.operators.aggregate import daily_flux, weighted_mean
from edaflux.operators.gapfill import fill_gaps
from edaflux.operators.soil import surface_gradient
from edaflux.plans.targets import build_sensor_month


def test_weighted_mean_edges(spark):
    rows = [("a", 2.0, 1.0), ("a", 4.0, 2.0), ("a", None, 1.0), ("a", 9.0, None), ("z", 1.0, 0.0), ("z", 3.0, 1.0), ("n", None, 1.0)]
    got = {r.k: r for r in weighted_mean(spark.createDataFrame(rows, "k string, flux double, flux_err double"), ["k"]).collect()}
    assert got["a"].flux == pytest.approx((2 * 1 + 4 * 0.25) / 1.25)
    assert got["a"].flux_err == pytest.approx(math.sqrt(1 / 1.25))
    assert (got["z"].flux, got["z"].flux_err) == (3.0, 1.0)
    assert (got["n"].flux, got["n"].flux_err) == (None, None)


def dense(values):
    known = [i for i, v in enumerate(values) if v is not None]
    out = list(values)
    for i, v in enumerate(values):
        if v is None and known and known[0] < i < known[-1]:
            out[i] = float(np.interp(i, known, [values[k] for k in known]))
    return out


@pytest.mark.parametrize("pieces", [1, 3, 40, 200])
def test_fill_gaps_matches_interpolation_in_any_number_of_pieces(spark, pieces):
    rng = np.random.default_rng(1)
    series, rows = {}, []
    for site, share in (("a", 0.5), ("b", 0.95), ("c", 0.0), ("d", 1.0), (None, 0.4)):
        values = [None if rng.random() < share else float(rng.normal()) for _ in range(300)]
        second = [None if rng.random() < share else float(rng.normal()) for _ in range(300)]
        # Uneven times: distance counts rows, not hours.
        times = np.cumsum(rng.integers(1, 9, 300))
        series[site] = (dense(values), dense(second))
        rows += [(site, dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(t)), v, w) for t, v, w in zip(times, values, second)]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r) for r in rows], "site string, ts timestamp, x double, y double").repartition(4)
    got = {}
    conf = {"spark.sql.shuffle.partitions": str(pieces), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    with settings(spark, conf):
        filled = fill_gaps(df, ["site"], "ts", ["x", "y"]).orderBy("ts").collect()
    for r in filled:
        got.setdefault(r.site, ([], []))
        got[r.site][0].append(r.x)
        got[r.site][1].append(r.y)
    for site, pair in series.items():
        for want, have in zip(pair, got[site]):
            assert len(want) == len(have)
            for w, h in zip(want, have):
                assert (w is None and h is None) or w == pytest.approx(h, abs=1e-12)


def test_daily_flux_by_hand(spark):
    t0 = dt.datetime(2024, 1, 1)
    half = dt.timedelta(minutes=30)
    rows = [
        ("s", t0, "1", "m1", 2.0, 1.0), ("s", t0, "1", "m2", 4.0, 1.0), ("s", t0, "2", "m1", 5.0, 1.0),
        ("s", t0 + half, "1", "m1", None, 1.0),
        ("s", t0 + 2 * half, "1", "m1", 6.0, 2.0),
    ]
    cols = "site_id string, startDateTime timestamp, horizontalPosition string, method string, flux double, flux_err double"
    r = daily_flux(spark.createDataFrame(rows, cols)).first()
    e1 = math.sqrt(1 / 2)
    first = (3.0 / e1**2 + 5.0) / (1 / e1**2 + 1)
    err = math.sqrt(1 / (1 / e1**2 + 1))
    conv = 0.02161926
    assert r.flux == pytest.approx(conv * (first + (first + 6.0) / 2 + 6.0))
    assert r.flux_err == pytest.approx(conv * math.sqrt(err**2 + ((err + 2.0) / 2) ** 2 + 4.0))


def test_sensor_month_keeps_either_side(spark):
    day = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    cols = "site_id string, startDateTime timestamp, verticalPosition string, QF int, value double"
    temperature = spark.createDataFrame(
        [("s", day[0], "501", 0, 4.0), ("s", day[0], "501", 0, 6.0), ("s", day[1], "501", 1, 9.0), ("s", day[1], "501", 0, 1.0),
         ("s", day[2] + dt.timedelta(minutes=30), "501", 0, 9.0), ("s", day[2], "502", 0, 9.0)], cols)
    water = spark.createDataFrame([("s", day[0], "501", 0, 0.2), ("s", day[2], "501", 0, 0.4)], cols)
    got = {r.startDateTime.day: (r.SOILT, r.VSWC) for r in build_sensor_month(temperature, water).collect()}
    assert got == {1: (5.0, 0.2), 2: (1.0, None), 3: (None, 0.4)}


def test_surface_gradient(spark):
    rows = [("p", 3.0, 735.0), ("p", 9.0, 1345.0), ("p", 21.0, 2879.0), ("q", 5.0, 10.0)]
    got = {r.k: r for r in surface_gradient(spark.createDataFrame(rows, "k string, depth double, co2 double"), ["k"]).collect()}
    assert got["p"].gradient == pytest.approx(610 / 6)
    assert got["p"].surface_value == pytest.approx(735 - 3 * 610 / 6)
    assert got["q"].gradient is None and got["q"].surface_value is None
