"""Physical plans: pushed filters, broadcasts only by size, one scan and no Python where SQL suffices."""

from __future__ import annotations

import pytest
from compare import records_read
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog.views import Views
from edaflux.operators.filters import known_sites
from edaflux.operators.joins import attach_coefficients
from edaflux.operators.ranking import ensemble_summary
from edaflux.session import broadcast_if_small, settle, settle_observed

SQL = entry.oracle_sql()
# A Gram matrix of any size is solved in numpy, one row per group.
USES_ARROW = {"m8_ols_one_covariate", "m8_ols_two_covariates"}
QUICK = ["a3_daily_flux", "a4_ensemble_summary", "c16_taylor_coordinates", "d8_daily_intervals", "e8_regression_diagnostics",
         "e10_forecast_cycle", "k2_assimilate_forecast", "m1_ols_two_predictor", "m14_daily_forecast", "m15_horizon_forecast",
         "w1_gap_fill", "w3_surface_gradient"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUICK)
def test_stays_in_the_jvm(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "Python" not in text and "InPandas" not in text and "CartesianProduct" not in text
    assert "BroadcastNestedLoop" not in text


def test_date_range_reaches_the_scan(spark, sf_dir):
    text = plan(entry.queries()["d9_year_month_range"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate" in text


def test_coefficients_are_broadcast_only_up_to_the_bound(spark):
    rows = spark.range(1000).select((F.col("id") % 50).cast("string").alias("site_id"), "id")
    table = spark.range(50).select(F.col("id").cast("string").alias("site_id"), F.lit(1.0).alias("slope"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    small, large = attach_coefficients(rows, table, max_rows=50), attach_coefficients(rows, table, max_rows=49)
    assert "BroadcastHashJoin" in plan(small)
    assert "SortMergeJoin" in plan(large)
    assert small.count() == large.count() == 1000
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_site_filter_is_a_semi_join(spark, sf_dir):
    views = Views(spark, sf_dir)
    assert "LeftSemi" in plan(known_sites(views.ens_long, views.site_meta, site_column="field_site_id"))


def test_summary_reads_members_once(spark, sf_dir):
    before = records_read(spark)
    ensemble_summary(Views(spark, sf_dir).obs, ["site_id", "variable"], "value").collect()
    assert records_read(spark) - before == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_settled_tables_survive_lost_lineage(spark):
    df = settle(spark.range(10))
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 10
    assert broadcast_if_small(df, 5) is df


@pytest.mark.parametrize(("name", "most"), [("e9_forecast_statistics", 2), ("k2_assimilate_forecast", 2), ("d8_daily_intervals", 1), ("e10_forecast_cycle", 2)])
def test_sources_are_read_once_and_bounds_are_no_subqueries(spark, sf_dir, name, most):
    """Forecast and observations come from the same events here, each read once."""
    before = records_read(spark)
    df = entry.queries()[name](spark, sf_dir)
    df.collect()
    assert records_read(spark) - before <= most * spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert plan(df).split("Initial Plan")[0].count("Subquery") <= 3


def test_bounds_of_an_empty_table_are_null(spark):
    df = spark.createDataFrame([], "datetime timestamp, reference_datetime date, x int")
    table, seen = settle_observed(df, first=F.min("datetime"), made=F.min("reference_datetime"))
    assert table.select(seen["first"], seen["made"]).count() == 0
    assert spark.range(1).select(seen["first"].alias("a"), seen["made"].alias("b")).dtypes == [("a", "timestamp"), ("b", "date")]


def test_bytes_bound_a_broadcast(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array_repeat(F.lit(1.0), 50).alias("a"), F.create_map(F.lit("k"), F.array(F.lit("v"))).alias("m"))
    bytes_each = 8 + 1016 + (16 + 400) + (16 + 17) + (16 + 16 + 17)
    hinted = lambda most: "broadcast" in broadcast_if_small(df, max_bytes=most)._jdf.queryExecution().logical().toString()
    assert hinted(100 * bytes_each) and not hinted(100 * bytes_each - 1)
    assert not hinted(10) and broadcast_if_small(df.limit(0), max_bytes=0) is not None
