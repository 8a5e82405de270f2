"""Date and time functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from edaflux.functions import dates as D
from edaflux.session import settle_observed


@query("d1_day", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def _d1(v):
    return v.obs.select("event_id", D.day_of("ts").alias("day"))


@query("d2_week_start", "SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday FROM orders")
def _d2(v):
    return v.table("orders").select("o_orderkey", D.week_start("o_orderdate").alias("monday"))


@query("d3_days_of_month", """
    SELECT month, CAST(unnest(generate_series(month, last_day(month), INTERVAL 1 DAY)) AS DATE) AS day
    FROM (SELECT DISTINCT CAST(date_trunc('month', datetime) AS DATE) AS month FROM monthly)""")
def _d3(v):
    months = v.monthly.select(D.month_start("datetime").alias("month")).distinct()
    return months.select("month", F.explode(D.days_of_month("month")).alias("day"))


@query("d4_training_month", """
    WITH r AS (SELECT row_id, datetime, year(datetime) AS y, month(datetime) AS m, day(datetime) AS d FROM monthly),
    back AS (SELECT row_id, y, CASE WHEN d < 15 THEN m - 2 ELSE m - 1 END AS m FROM r),
    wrapped AS (SELECT row_id, CASE WHEN m <= 0 THEN y - 1 ELSE y END AS y,
                       CASE WHEN m = 0 THEN 12 WHEN m = -1 THEN 11 ELSE m END AS m FROM back)
    SELECT row_id, CAST(m AS INTEGER) AS train_month, CAST(y AS INTEGER) AS train_year, CAST(y - 1 AS INTEGER) AS year_before
    FROM wrapped""")
def _d4(v):
    first = D.training_month("datetime")
    return v.monthly.select(
        "row_id", F.month(first).alias("train_month"), F.year(first).alias("train_year"),
        D.training_year("datetime").alias("year_before"),
    )


@query("d5_month_arithmetic", """
    SELECT row_id, CAST(date_trunc('month', datetime) - INTERVAL 3 MONTH AS DATE) AS three_back,
           CAST(date_trunc('month', datetime) + INTERVAL 1 MONTH AS DATE) AS next_month
    FROM monthly""")
def _d5(v):
    return v.monthly.select(
        "row_id", D.months_before("datetime", 3).alias("three_back"), D.next_month("datetime").alias("next_month")
    )


@query("d5_preceding_months", """
    SELECT month, CAST(month - to_months(CAST(i AS INTEGER)) AS DATE) AS before
    FROM (SELECT DISTINCT CAST(date_trunc('month', datetime) AS DATE) AS month FROM monthly), range(1, 13) AS t(i)""")
def _d5_twelve(v):
    months = v.monthly.select(D.month_start("datetime").alias("month")).distinct()
    return months.select("month", F.explode(D.preceding_months("month", 12)).alias("before"))


@query("d6_horizon_days", "SELECT event_id, CAST(day - DATE '2024-01-01' AS INTEGER) AS horizon FROM obs")
def _d6(v):
    return v.obs.select("event_id", D.horizon_days("day", F.lit("2024-01-01").cast("date")).alias("horizon"))


@query("d7_next_evaluation", """
    SELECT event_id, day + (CASE WHEN event_id % 2 = 0 THEN 1 ELSE 14 END) AS next_eval FROM obs""")
def _d7(v):
    duration = F.when(F.col("event_id") % 2 == 0, "P1D").otherwise("P1W")
    return v.obs.select("event_id", D.next_evaluation("day", duration).alias("next_eval"))


# The SQL looks for the first interval that holds the row, by trying every one; Spark computes it.
_INTERVALS = """
    WITH span AS (SELECT CAST(date_trunc('week', min({ts})) AS TIMESTAMP) AS s, CAST(max({ts}) AS TIMESTAMP) AS e FROM obs),
    starts AS (SELECT unnest(generate_series(s, e, INTERVAL {step} DAY)) AS a, e FROM span),
    spans AS (SELECT a, a + INTERVAL {length} DAY AS b, row_number() OVER (ORDER BY a) AS k FROM starts
              WHERE a + INTERVAL {length} DAY <= e)
    SELECT o.event_id, CAST(min(k) AS INTEGER) AS interval_id
    FROM obs o LEFT JOIN spans ON o.{ts} >= a AND o.{ts} <= b GROUP BY o.event_id"""


@query("d8_daily_intervals", _INTERVALS.format(ts="ts", step=1, length=1))
def _d8_daily(v):
    obs, seen = settle_observed(v.obs.select("event_id", "ts"), first=F.min("ts"), last=F.max("ts"))
    return obs.select("event_id", D.interval_id("ts", D.week_start(seen["first"]), seen["last"], "P1D").alias("interval_id"))


@query("d8_weekly_intervals", _INTERVALS.format(ts="day", step=7, length=14))
def _d8_weekly(v):
    obs, seen = settle_observed(v.obs.select("event_id", "day"), first=F.min("day"), last=F.max("day"))
    return obs.select("event_id", D.interval_id("day", D.week_start(seen["first"]), seen["last"], "P1W").alias("interval_id"))


@query("d9_year_month_range", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1998 AND month(o_orderdate) IN (4, 5)""")
def _d9(v):
    rows = v.table("orders")
    kind = rows.schema["o_orderdate"].dataType.simpleString()
    bounds = [F.lit(d).cast(kind) for d in ("1998-04-01", "1998-06-01")]
    return rows.where(D.in_months("o_orderdate", *bounds)).select("o_orderkey", "o_totalprice")
