"""Order statistics against brute force, with a hot group, ties, signs, nulls and a null key."""

from __future__ import annotations

import numpy as np
import pytest
from compare import settings

from edaflux.operators.evaluate import sample_crps, score_ensemble
from edaflux.operators.ranking import ensemble_summary, pairwise_spread, quantiles, value_ranks
from edaflux.schemas import QUANTILES
from edaflux.session import settle


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [("hot", float(v)) for v in rng.normal(0, 5, 4000)]
    out += [("hot", 1.25)] * 1500 + [("hot", None)] * 20
    out += [("ties", float(v)) for v in rng.integers(-3, 4, 300)]
    out += [("narrow", float(v)) for v in rng.normal(101325, 5, 500)]
    out += [("wild", float(np.exp(v))) for v in rng.normal(0, 8, 400)] + [("wild", 0.0), ("wild", -1e-300)]
    out += [("one", 7.0), ("nulls", None), ("nulls", None), (None, 1.0), (None, 2.0), (None, 4.0)]
    rng.shuffle(out)
    return [(k, None if v is None else float(v)) for k, v in out]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, v double").repartition(5)


def groups(rows):
    out = {}
    for k, v in rows:
        out.setdefault(k, [])
        if v is not None:
            out[k].append(v)
    return out


def test_ranks(df, rows):
    got = value_ranks(df, ["k"], "v").collect()
    want = groups(rows)
    assert sum(r.copies for r in got) == sum(len(v) for v in want.values())
    for r in got:
        values = np.array(want[r.k])
        assert (r.copies, r.below, r.size) == ((values == r.v).sum(), (values < r.v).sum(), len(values))


def test_summary_matches_numpy(df, rows):
    got = {r.k: r for r in ensemble_summary(df, ["k"], "v").collect()}
    want = groups(rows)
    assert set(got) == set(want)
    for k, values in want.items():
        r = got[k]
        if not values:
            assert all(r[c] is None for c in ("mean", "sd", *QUANTILES))
            continue
        assert r["mean"] == pytest.approx(np.mean(values), rel=1e-10, abs=1e-12)
        for name, p in QUANTILES.items():
            assert r[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300)
        if len(values) > 1:
            assert r["sd"] == pytest.approx(np.std(values, ddof=1), rel=1e-9)
        else:
            assert r["sd"] is None


def test_quantiles_ascend(df):
    for r in quantiles(df, ["k"], "v").collect():
        values = [r[c] for c in QUANTILES]
        assert values == sorted(values)


def test_spread_and_crps_match_the_double_loop(spark, df, rows):
    spread = {r.k: r for r in pairwise_spread(df, ["k"], "v").collect()}
    y = {k: 1.5 for k in groups(rows) if k}
    observed = spark.createDataFrame(list(y.items()), "k string, flux double")
    crps = {r.k: r.crps for r in sample_crps(df, ["k"], "v", observed).collect()}
    for k, values in groups(rows).items():
        if not values or k == "wild":
            continue
        x = np.array(values)
        pairs = np.abs(x[:, None] - x[None, :]).mean()
        assert spread[k].mean_abs_difference == pytest.approx(pairs, rel=1e-9, abs=1e-12)
        if k:
            assert crps[k] == pytest.approx(np.abs(x - 1.5).mean() - pairs / 2, rel=1e-9, abs=1e-9)
    assert "nulls" not in crps


def test_score_keeps_observed_groups_only(spark, df):
    observed = spark.createDataFrame([("one", 6.0), ("nulls", 1.0), ("absent", 2.0)], "k string, flux double")
    got = {r.k: r for r in score_ensemble(df, ["k"], "v", observed).collect()}
    assert set(got) == {"one", "nulls"}
    assert got["one"].crps == pytest.approx(1.0) and got["one"].sd is None
    assert got["nulls"].crps is None and got["nulls"].flux == 1.0


def test_infinities_and_nan(spark):
    rows = [("up", 1.0), ("up", 2.0), ("up", float("inf")), ("both", float("inf")), ("both", float("-inf")), ("both", 0.0),
            ("nan", 1.0), ("nan", 2.0), ("nan", 3.0), ("nan", float("nan")), ("all", float("inf")), ("all", float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in ensemble_summary(df, ["k"], "v").collect()}
    assert got["up"].mean == float("inf") and got["up"].sd is None and got["up"].q0500 == 2.0 and got["up"].q0975 == float("inf")
    assert got["both"].mean is None and got["both"].q0500 == 0.0 and got["both"].q0025 == float("-inf")
    assert (got["nan"].mean, got["nan"].sd, got["nan"].q0500) == (2.0, 1.0, 2.0)
    assert got["all"].q0025 == got["all"].q0975 == float("inf") and got["all"].sd is None
    spread = {r.k: r.mean_abs_difference for r in pairwise_spread(df, ["k"], "v").collect()}
    assert spread["up"] is None and spread["nan"] == pytest.approx(8 / 9)
    crps = {r.k: r.crps for r in score_ensemble(df, ["k"], "v", spark.createDataFrame([("up", 1.0), ("nan", 2.0)], "k string, flux double")).collect()}
    assert crps["up"] is None and crps["nan"] == pytest.approx(2 / 3 - 4 / 9)


def test_each_observation_of_a_key_is_scored_by_itself(spark):
    members = spark.createDataFrame([("a", float(v)) for v in range(5)], "k string, v double")
    observed = spark.createDataFrame([("a", 2.5), ("a", 2.5), ("a", 9.0)], "k string, flux double")
    got = {r.flux: r for r in score_ensemble(members, ["k"], "v", observed).collect()}
    assert set(got) == {2.5, 9.0}
    assert got[2.5].sd == got[9.0].sd == pytest.approx(1.5811388) and got[2.5].crps == pytest.approx(0.5)


def test_a_narrow_group_is_cut_evenly(spark):
    """Half a million values within a relative spread of one millionth: no piece holds over a fiftieth of them."""
    from pyspark.sql import functions as F

    from edaflux.operators.ordering import range_parts

    df = settle(spark.range(500_000).select(F.lit("a").alias("k"), (F.lit(101325.0) + F.randn(3) * 0.1).alias("v")))
    with settings(spark, {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
                          "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k"}):
        cut = range_parts(df, ["k", "v"])
        sizes = cut.groupBy("_part").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_part").collect()
        assert max(r.n for r in sizes) < 10_000 and sum(r.n for r in sizes) == 500_000
        assert all(a.hi < b.lo for a, b in zip(sizes, sizes[1:], strict=False))
        got = quantiles(df, ["k"], "v").first()
    values = np.array([r.v for r in df.select("v").collect()])
    for name, p in QUANTILES.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-15)


def test_pieces_of_one_group_grow_in_number_with_it(spark):
    from pyspark.sql import functions as F

    from edaflux.operators.ordering import range_parts

    with settings(spark, {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
                          "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}):
        parts = [range_parts(spark.range(n).select(F.lit("a").alias("k"), F.rand(1).alias("v")), ["k", "v"]).select("_part").distinct().count() for n in (40_000, 400_000)]
    assert 5 * parts[0] <= parts[1] <= 200
    assert range_parts(spark.range(10), ["id"], rows=10).select("_part").distinct().count() == 1
    assert range_parts(spark.range(10), ["id"], rows=10 * 65_536).select("_part").distinct().count() == 10
