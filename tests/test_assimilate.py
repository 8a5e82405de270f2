from __future__ import annotations

import numpy as np
import pytest

from edaflux.operators.assimilate import kalman_update


def run(spark, rows, obs, **options):
    members = spark.createDataFrame(rows, "g string, m int, prediction double")
    observed = spark.createDataFrame(obs, "g string, observation double")
    out = kalman_update(members, observed, ["g"], ic_sd=2.0, member_keys=["g", "m"], **options)
    return {(r.g, r.m): r.prediction for r in out.collect()}


ROWS = [("a", i, float(v)) for i, v in enumerate((1, 4, 7, 12))] + [("one", 0, 5.0), ("none", 0, 1.0), ("none", 1, 3.0)]


def test_exact_update(spark):
    got = run(spark, ROWS, [("a", 10.0), ("one", 9.0)], perturb=0)
    x = np.array([1.0, 4, 7, 12])
    gain = x.var(ddof=1) / (x.var(ddof=1) + 4.0)
    for i, v in enumerate(x):
        assert got["a", i] == pytest.approx(v + gain * (10 - v))
    assert got["one", 0] == 5.0
    assert (got["none", 0], got["none", 1]) == (1.0, 3.0)


def test_identical_members_do_not_move(spark):
    got = run(spark, [("a", i, 3.0) for i in range(4)], [("a", 10.0)], perturb=0)
    assert set(got.values()) == {3.0}


def test_perturbed_update_is_repeatable_and_per_member(spark):
    a = run(spark, ROWS, [("a", 10.0)], seed=3)
    assert a == run(spark, ROWS[::-1], [("a", 10.0)], seed=3)
    assert a != run(spark, ROWS, [("a", 10.0)], seed=4)
