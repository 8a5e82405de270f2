"""Scaled components at the edges of doubles."""

from __future__ import annotations

from edaflux.llm import topk


def test_tiny_negative_and_large_components(spark):
    rows = [(1, [-1e-18, 0.04687499999999999]), (2, [1.7e13, -7e16]), (3, [8e16, 0.0]), (4, [float("inf"), 0.0]), (5, [float("nan"), 0.0]), (6, [None, 0.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {r["id"]: r["s"] for r in df.select("id", topk.scaled(df["v"]).alias("s")).collect()}
    assert got == {1: [-1, 2], 2: [64 * 17 * 10**12, -64 * 7 * 10**16], 3: None, 4: None, 5: None, 6: None}
