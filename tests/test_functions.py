"""Scalar, date, noise and p-value expressions on hand-made rows."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from edaflux.functions import dates as D
from edaflux.functions import scalars as S
from edaflux.functions.noise import keyed_gaussian
from edaflux.functions.pvalues import f_one_upper, t_two_sided


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sentinel_and_nan_become_null(spark):
    df = spark.createDataFrame([(9999.0,), (float("nan"),), (None,), (3.5,)], "v double")
    assert [r[0] for r in df.select(S.sentinel_to_null("v")).collect()] == [None, None, None, 3.5]


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "v double")
    assert [r[0] for r in df.select(S.clamp_at_zero("v")).collect()] == [0.0, 2.0, None]


@pytest.mark.parametrize("text,title", [
    ("evergreen needle-leaf", "Evergreen Needle-Leaf"), ("DECIDUOUS broadleaf", "Deciduous Broadleaf"), ("", ""),
    ("don't", "Don't"),
])
def test_title_case(spark, text, title):
    assert one(spark, S.title_case(F.lit(text))) == title


def test_water_response_edges(spark):
    values = [0.0, 0.2, 0.42, 0.5, None]
    df = spark.createDataFrame([(v,) for v in values], "w double")
    got = [r[0] for r in df.select(S.moyano_water_response("w")).collect()]
    assert got[0] == pytest.approx(0.42 ** (10 / 3) / 0.1764)
    assert got[1] == pytest.approx(0.22 ** (10 / 3) / 0.1764)
    assert got[2:] == [0.0, 0.0, None]


def test_diurnal_temperature(spark):
    assert one(spark, S.diurnal_temperature(F.lit(6))) == pytest.approx(20.0)


def test_taylor_y_survives_r_past_one(spark):
    assert one(spark, S.taylor_y(F.lit(2.0), F.lit(1.0 + 1e-15))) == 0.0
    assert one(spark, S.taylor_y(F.lit(2.0), F.lit(None).cast("double"))) is None


@pytest.mark.parametrize("day,month,before", [
    ("2025-01-14", "2024-11-01", 2023), ("2025-01-15", "2024-12-01", 2023), ("2025-02-14", "2024-12-01", 2023),
    ("2025-02-15", "2025-01-01", 2024), ("2025-03-14", "2025-01-01", 2024), ("2025-12-31", "2025-11-01", 2024),
])
def test_training_month(spark, day, month, before):
    c = F.lit(day).cast("date")
    assert str(one(spark, D.training_month(c))) == month
    assert one(spark, D.training_year(c)) == before


def test_training_month_matches_stepwise_rule(spark):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(800)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select("d", D.training_month("d").alias("t"))
    for r in df.collect():
        month, year = r.d.month - (2 if r.d.day < 15 else 1), r.d.year
        if month <= 0:
            month, year = month + 12, year - 1
        assert r.t == dt.date(year, month, 1)


def test_preceding_months(spark):
    got = one(spark, D.preceding_months(F.lit("2025-03-31").cast("date"), 12))
    assert got[0] == dt.date(2025, 2, 1) and got[-1] == dt.date(2024, 3, 1) and len(got) == 12


def test_days_of_leap_february(spark):
    got = one(spark, D.days_of_month(F.lit("2024-02-11").cast("date")))
    assert len(got) == 29 and got[-1] == dt.date(2024, 2, 29)


@pytest.mark.parametrize("duration,step,length", [("P1D", 1, 1), ("P1W", 7, 14)])
@pytest.mark.parametrize("extent_hours", [6, 24, 300, 336, 700, 731])
def test_interval_is_the_first_that_holds_the_row(spark, duration, step, length, extent_hours):
    start = dt.datetime(2024, 1, 1)
    end = start + dt.timedelta(hours=extent_hours)
    times = [start + dt.timedelta(hours=h) for h in range(-3, extent_hours + 1)]
    spans, a, k = [], start, 1
    while a <= end:
        if a + dt.timedelta(days=length) <= end:
            spans.append((k, a, a + dt.timedelta(days=length)))
        a, k = a + dt.timedelta(days=step), k + 1
    df = spark.createDataFrame([(t,) for t in times], "t timestamp").select(
        "t", D.interval_id("t", F.lit(start), F.lit(end), duration).alias("k")
    )
    for r in df.collect():
        assert r.k == next((k for k, a, b in spans if a <= r.t <= b), None), r.t


def test_noise_depends_on_keys_only(spark):
    df = spark.range(10_000).withColumn("site", (F.col("id") % 7).cast("string"))
    z = keyed_gaussian(5, "process", ["id", "site"]).alias("z")
    a = {r.id: r.z for r in df.repartition(1).select("id", z).collect()}
    b = {r.id: r.z for r in df.repartition(7).select("id", z).collect()}
    assert a == b
    values = np.array(list(a.values()))
    assert abs(values.mean()) < 0.04 and abs(values.std() - 1) < 0.03
    other = [r.z for r in df.select("id", keyed_gaussian(5, "sigma", ["id", "site"]).alias("z")).orderBy("id").collect()]
    assert abs(np.corrcoef([a[i] for i in range(10_000)], other)[0, 1]) < 0.04


def tail(t, n):
    theta = math.atan(t / math.sqrt(n))
    top = min(math.pi / 2, theta + 60 / math.sqrt(n))
    x = np.linspace(theta, top, 100_001)
    y = np.cos(x) ** (n - 1)
    area = (top - theta) / 300_000 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    return 2 * area * math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(math.pi)


def test_two_sided_p(spark):
    rows = [(t, n) for n in (1, 2, 3, 4, 29, 30, 199, 200, 201, 202, 597, 5000) for t in (0.0, 0.05, 0.3, 1.0, 2.5, 7.0)]
    df = spark.createDataFrame(rows, "t double, n long").select(
        "t", "n", t_two_sided(F.col("t"), F.col("n")).alias("p"), t_two_sided(-F.col("t"), F.col("n")).alias("m"),
        f_one_upper(F.col("t") * F.col("t"), F.col("n")).alias("f"),
    )
    for r in df.collect():
        assert r.p == pytest.approx(tail(r.t, r.n), abs=1e-9)
        assert r.p == r.m and r.f == pytest.approx(r.p, abs=1e-12)


def test_p_is_null_without_degrees_of_freedom(spark):
    assert one(spark, t_two_sided(F.lit(1.0), F.lit(0))) is None
    assert one(spark, t_two_sided(F.lit(None).cast("double"), F.lit(5))) is None


def _atan(x):
    """arctangent of a positive Decimal by Euler's series, after reduction to at most one."""
    if x > 1:
        return 2 * _atan(Decimal(1)) - _atan(1 / x)
    total, n, term = Decimal(0), 0, x / (1 + x * x)
    while term > Decimal(10) ** -(getcontext().prec - 5):
        total += term
        n += 1
        term *= Decimal(2 * n) / (2 * n + 1) * x * x / (1 + x * x)
    return total


def _exact_tail(t: float, df: int) -> Decimal:
    """P(|T| > t) from the finite series, with digits enough to subtract it from one."""
    x = Decimal(t)
    sin, cos2 = x / (x * x + df).sqrt(), Decimal(df) / (x * x + df)
    term = total = Decimal(1)
    for k in range(1, (df - 3) // 2 + 1 if df % 2 else (df - 2) // 2 + 1):
        term *= cos2 * (Decimal(2 * k) / (2 * k + 1) if df % 2 else Decimal(2 * k - 1) / (2 * k))
        total += term
    if df % 2 == 0:
        return 1 - sin * total
    theta = _atan(x / Decimal(df).sqrt())
    return 1 - (theta + (sin * cos2.sqrt() * total if df > 1 else 0)) / (2 * _atan(Decimal(1)))


def test_tail_to_the_last_digits(spark):
    getcontext().prec = 260
    cases = [(t, df) for df in (1, 2, 3, 4, 7, 30, 199, 200, 201, 1000, 5000) for t in (1e-6, 0.3, 1.0, 2.5, 9.0, 20.0, 30.0)]
    rows = spark.createDataFrame(cases, "t double, n int").select("t", "n", t_two_sided(F.col("t"), F.col("n")).alias("p")).collect()
    for r in rows:
        want = _exact_tail(r.t, r.n)
        assert abs(Decimal(r.p) / want - 1) < Decimal("1e-8"), (r.t, r.n, r.p, float(want))
