"""The given tables seen as the forecasting workflow's tables, once in Spark and once in SQL.

``events`` stands for the weather ensemble and the observations, ``orders`` for monthly tables, ``lineitem`` for
large regressions, ``supplier`` with ``nation`` for site metadata.

The tables' two-decimal numbers are scaled by pi/3. Means of plain decimals often end exactly halfway between two
rounded values, where the last bit of a sum, and so the order an engine adds in, would decide the printed digits.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edaflux.functions.scalars import sentinel_to_null
from edaflux.schemas import ENV_VARS
from edaflux.session import ensure_utc

RUN_DATE = "2024-01-01"
SCALE = 1.0471975511965976


class Views:
    """Views over one folder of tables; each is planned when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = ensure_utc(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def obs(self) -> DataFrame:
        """Events by site and day, each with the variable it stands for."""
        third = F.col("event_id") % 3
        variable = (
            F.when(F.col("event_type") == "view", "TSOIL").when(F.col("event_type") == "click", "SOILW")
            .when(F.col("event_type") == "purchase", "PRES").when(F.col("event_type") == "signup", "FLUX")
            .when(third == 0, "WEASD").when(third == 1, "SNOD").otherwise("ICETK")
        )
        return self.table("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).cast("string").alias("site_id"),
            F.to_date("ts").alias("day"), variable.alias("variable"), "event_type",
            (F.col("value") * SCALE).alias("value"),
        )

    @cached_property
    def ens_long(self) -> DataFrame:
        """One run made on the first day, all events as members of it."""
        start = F.unix_micros(F.lit(RUN_DATE).cast("timestamp"))
        return self.obs.select(
            _member().alias("ensemble"), ((F.unix_micros("ts") - start) / F.lit(1_000_000)).alias("horizon"),
            F.col("ts").alias("datetime"), F.lit("ensemble").alias("family"), "site_id", "variable",
            _with_sentinel().alias("prediction"), F.lit(RUN_DATE).cast("date").alias("reference_datetime"), "day",
        )

    @cached_property
    def ens_runs(self) -> DataFrame:
        """Runs made up to two days before, valid at midnight of the event's day."""
        lead = (F.col("event_id") % 3).cast("int")
        return self.obs.select(
            _member().alias("ensemble"), (lead * F.lit(86400.0)).alias("horizon"),
            F.col("day").cast("timestamp").alias("datetime"), F.lit("ensemble").alias("family"), "site_id", "variable",
            _with_sentinel().alias("prediction"), F.date_sub("day", lead).alias("reference_datetime"), "day", "value",
        )

    @cached_property
    def ens_wide(self) -> DataFrame:
        """One row per site, day and member; the average of each variable."""
        clean = self.ens_long.withColumn("prediction", sentinel_to_null("prediction"))
        means = [F.avg(F.when(F.col("variable") == n, F.col("prediction"))).alias(n) for n in ENV_VARS]
        wide = clean.groupBy("site_id", "day", "ensemble").agg(*means)
        return wide.select(
            "site_id", "day", "ensemble", F.col("day").cast("timestamp").alias("datetime"),
            F.lit(RUN_DATE).cast("date").alias("reference_datetime"), F.lit("ensemble").alias("family"),
            (F.datediff("day", F.lit(RUN_DATE).cast("date")) * F.lit(86400.0)).alias("horizon"), *ENV_VARS,
        )

    @cached_property
    def drivers_day(self) -> DataFrame:
        """Daily drivers by site; ``datetime`` is a date."""
        means = [F.avg(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in ENV_VARS]
        return self.obs.groupBy("site_id", F.col("day").alias("datetime")).agg(*means)

    @cached_property
    def targets_day(self) -> DataFrame:
        """Daily flux and its error by site."""
        return self.obs.where(F.col("variable") == "FLUX").groupBy("site_id", F.col("day").alias("datetime")).agg(
            F.avg("value").alias("flux"), F.stddev_samp("value").alias("flux_err")
        )

    @cached_property
    def half_hour(self) -> DataFrame:
        slot = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 1800) * 1800)
        return self.obs.select(
            "site_id", slot.alias("startDateTime"), (F.col("event_id") % 3).cast("string").alias("horizontalPosition"),
            F.col("event_type").alias("method"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("flux"),
            (F.lit(1.0) + F.col("event_id") % 7).alias("flux_err"), "day",
        )

    @cached_property
    def sensor(self) -> DataFrame:
        return self.obs.select(
            "site_id", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 1800) * 1800).alias("startDateTime"),
            (500 + F.col("event_id") % 3).cast("string").alias("verticalPosition"),
            (F.col("event_id") % 5).cast("string").alias("horizontalPosition"),
            (F.col("event_id") % 2).cast("int").alias("QF"), "value", "variable", "day", "event_id",
        )

    @cached_property
    def site_meta(self) -> DataFrame:
        """Suppliers as sites. ``nation`` is a fixed table, which its statistics show to the optimizer."""
        return self.table("supplier").join(
            self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")
        ).select(
            F.col("s_suppkey").cast("string").alias("field_site_id"), F.col("s_acctbal").alias("field_latitude"),
            (-F.col("s_acctbal")).alias("field_longitude"), F.when(F.col("s_acctbal") > 0, 1).otherwise(0).alias("terrestrial"),
            F.col("n_name").alias("phenocam_vegetation"),
        )

    @cached_property
    def forecast_long(self) -> DataFrame:
        """Members of two variables on days: the shape of a submitted ensemble forecast."""
        return self.obs.where(F.col("variable").isin("TSOIL", "SOILW")).select(
            "site_id", "variable", F.col("day").alias("datetime"), F.col("event_id").cast("string").alias("parameter"),
            F.lit(RUN_DATE).cast("date").alias("reference_datetime"), F.col("value").alias("prediction"),
        )

    @cached_property
    def challenge(self) -> DataFrame:
        """Daily observations of the same variables."""
        return self.obs.where(F.col("variable").isin("TSOIL", "SOILW")).groupBy(
            "site_id", "variable", F.col("day").alias("datetime")
        ).agg(F.max("value").alias("observation")).select(
            F.lit("demo").alias("project_id"), "site_id", "datetime", F.lit("P1D").alias("duration"), "variable", "observation"
        )

    @cached_property
    def reg_big(self) -> DataFrame:
        return self.table("lineitem").select(
            "l_suppkey", F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"),
            F.col("l_tax").alias("x3"),
        )

    @cached_property
    def monthly(self) -> DataFrame:
        """Orders as dated monthly values."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 10).cast("string").alias("site_id"),
            F.to_date("o_orderdate").alias("datetime"), (F.col("o_totalprice") * SCALE).alias("flux"),
        )

    def forecast_scored(self) -> DataFrame:
        """Daily quantiles of TSOIL members next to the observed flux."""
        from edaflux.operators.aggregate import ensemble_summary

        members = self.ens_wide.select("site_id", F.col("day").alias("datetime"), F.col("TSOIL").alias("value"))
        return ensemble_summary(members, ["site_id", "datetime"]).join(self.targets_day, ["site_id", "datetime"])


def _member() -> Column:
    return F.concat(F.lit("gec"), F.lpad((F.col("event_id") % 31).cast("string"), 2, "0"))


def _with_sentinel() -> Column:
    return F.when(F.col("event_id") % 97 == 0, F.lit(9999.0)).otherwise(F.col("value"))


# The same views in SQL, each named and using only those above it.
SQL_VIEWS: dict[str, str] = {
    "obs": """
        SELECT event_id, ts, CAST(user_id % 10 AS VARCHAR) AS site_id, CAST(ts AS DATE) AS day,
               CASE WHEN event_type = 'view' THEN 'TSOIL' WHEN event_type = 'click' THEN 'SOILW'
                    WHEN event_type = 'purchase' THEN 'PRES' WHEN event_type = 'signup' THEN 'FLUX'
                    WHEN event_id % 3 = 0 THEN 'WEASD' WHEN event_id % 3 = 1 THEN 'SNOD' ELSE 'ICETK' END AS variable,
               event_type, value * 1.0471975511965976::DOUBLE AS value
        FROM events""",
    "ens_long": """
        SELECT 'gec' || lpad(CAST(event_id % 31 AS VARCHAR), 2, '0') AS ensemble,
               (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE AS horizon,
               ts AS datetime, 'ensemble' AS family, site_id, variable,
               CASE WHEN event_id % 97 = 0 THEN 9999.0::DOUBLE ELSE value END AS prediction,
               DATE '2024-01-01' AS reference_datetime, day
        FROM obs""",
    "ens_runs": """
        SELECT 'gec' || lpad(CAST(event_id % 31 AS VARCHAR), 2, '0') AS ensemble,
               (event_id % 3) * 86400.0::DOUBLE AS horizon, CAST(day AS TIMESTAMP) AS datetime, 'ensemble' AS family,
               site_id, variable, CASE WHEN event_id % 97 = 0 THEN 9999.0::DOUBLE ELSE value END AS prediction,
               day - CAST(event_id % 3 AS INTEGER) AS reference_datetime, day, value
        FROM obs""",
    "ens_cells": """
        SELECT site_id, day, ensemble, variable, avg(NULLIF(prediction, 9999.0)) AS prediction
        FROM ens_long GROUP BY ALL""",
    "ens_wide": """
        SELECT site_id, day, ensemble, CAST(day AS TIMESTAMP) AS datetime, DATE '2024-01-01' AS reference_datetime,
               'ensemble' AS family, (day - DATE '2024-01-01') * 86400.0::DOUBLE AS horizon,
               max(CASE WHEN variable = 'PRES' THEN prediction END) AS "PRES",
               max(CASE WHEN variable = 'TSOIL' THEN prediction END) AS "TSOIL",
               max(CASE WHEN variable = 'SOILW' THEN prediction END) AS "SOILW",
               max(CASE WHEN variable = 'WEASD' THEN prediction END) AS "WEASD",
               max(CASE WHEN variable = 'SNOD' THEN prediction END) AS "SNOD",
               max(CASE WHEN variable = 'ICETK' THEN prediction END) AS "ICETK"
        FROM ens_cells GROUP BY site_id, day, ensemble""",
    "drivers_day": """
        SELECT site_id, day AS datetime,
               avg(value) FILTER (variable = 'PRES') AS "PRES", avg(value) FILTER (variable = 'TSOIL') AS "TSOIL",
               avg(value) FILTER (variable = 'SOILW') AS "SOILW", avg(value) FILTER (variable = 'WEASD') AS "WEASD",
               avg(value) FILTER (variable = 'SNOD') AS "SNOD", avg(value) FILTER (variable = 'ICETK') AS "ICETK"
        FROM obs GROUP BY site_id, day""",
    "targets_day": """
        SELECT site_id, day AS datetime, avg(value) AS flux, stddev_samp(value) AS flux_err
        FROM obs WHERE variable = 'FLUX' GROUP BY site_id, day""",
    "half_hour": """
        SELECT site_id, make_timestamp((epoch_us(ts) // 1800000000) * 1800000000) AS startDateTime,
               CAST(event_id % 3 AS VARCHAR) AS horizontalPosition, event_type AS method,
               CASE WHEN event_id % 11 <> 0 THEN value END AS flux, 1.0::DOUBLE + event_id % 7 AS flux_err, day
        FROM obs""",
    "sensor": """
        SELECT site_id, make_timestamp((epoch_us(ts) // 1800000000) * 1800000000) AS startDateTime,
               CAST(500 + event_id % 3 AS VARCHAR) AS verticalPosition, CAST(event_id % 5 AS VARCHAR) AS horizontalPosition,
               CAST(event_id % 2 AS INTEGER) AS QF, value, variable, day, event_id
        FROM obs""",
    "site_meta": """
        SELECT CAST(s_suppkey AS VARCHAR) AS field_site_id, s_acctbal AS field_latitude, -s_acctbal AS field_longitude,
               CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS terrestrial, n_name AS phenocam_vegetation
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "forecast_long": """
        SELECT site_id, variable, day AS datetime, CAST(event_id AS VARCHAR) AS parameter,
               DATE '2024-01-01' AS reference_datetime, value AS prediction
        FROM obs WHERE variable IN ('TSOIL', 'SOILW')""",
    "challenge": """
        SELECT 'demo' AS project_id, site_id, day AS datetime, 'P1D' AS duration, variable, max(value) AS observation
        FROM obs WHERE variable IN ('TSOIL', 'SOILW') GROUP BY site_id, variable, day""",
    "reg_big": """
        SELECT l_suppkey, l_extendedprice AS y, l_quantity AS x1, l_discount AS x2, l_tax AS x3 FROM lineitem""",
    "monthly": """
        SELECT o_orderkey AS row_id, CAST(o_custkey % 10 AS VARCHAR) AS site_id, CAST(o_orderdate AS DATE) AS datetime,
               o_totalprice * 1.0471975511965976::DOUBLE AS flux
        FROM orders""",
    "tsoil_summary": """
        SELECT site_id, day AS datetime, avg("TSOIL") AS mean, stddev_samp("TSOIL") AS sd,
               quantile_cont("TSOIL", 0.025) AS q0025, quantile_cont("TSOIL", 0.1) AS q0100,
               quantile_cont("TSOIL", 0.5) AS q0500, quantile_cont("TSOIL", 0.9) AS q0900,
               quantile_cont("TSOIL", 0.975) AS q0975
        FROM ens_wide GROUP BY site_id, day""",
    "forecast_scored": """
        SELECT s.*, t.flux, t.flux_err FROM tsoil_summary s JOIN targets_day t USING (site_id, datetime)""",
}


def with_views(sql: str) -> str:
    """Prefix the statement with the views it needs, in order. A statement may begin with its own WITH."""
    needed: set[str] = set()

    def collect(text: str) -> None:
        for name in SQL_VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                collect(SQL_VIEWS[name])

    collect(sql)
    views = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in SQL_VIEWS if n in needed)
    body = sql.strip()
    if not views:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
