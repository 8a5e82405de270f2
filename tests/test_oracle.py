"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import pytest
from compare import check, duck, mismatch

import __spark_entry__ as entry
import catalog

QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", OWN)
def test_matches_sql(spark, con, sf_dir, name):
    # Groups of two days have r = 1 up to the last bit, and sqrt(1 - r^2) magnifies that bit to 1e-8.
    rows, _, diff, kinds = check(spark, con, sf_dir, name, QUERIES[name], SQL[name], tolerance=1e-9, absolute=1e-6)
    assert not diff, diff
    assert {k: v for k, v in kinds.items() if mismatch(*v)} == {}


def test_only_text_operators_lack_sql():
    """Every query of the forecasting engine has SQL; what SQL can't express is tested beside the text operators."""
    assert all(n == "pipeline" or n.startswith("op") for n in set(QUERIES) - set(SQL))


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_smoke_entry(spark):
    assert entry.entry(spark).count() > 0
