"""Theil-Sen by counting against the listed pairs."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.operators import clocks, robust


def listed(x, y):
    slopes = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in itertools.combinations(list(zip(x, y)), 2) if a[0] != b[0]]
    return float(np.median(slopes)) if slopes else 0.0


@pytest.mark.parametrize("seed", range(12))
def test_median_slope(monkeypatch, seed):
    monkeypatch.setattr(robust, "LEAST_LISTED", 20)
    monkeypatch.setattr(robust, "LISTED", 1)
    r = np.random.default_rng(seed)
    for n in (1, 2, 3, 7, 40, 121):
        x = r.integers(0, [5, 1000, 10**9][seed % 3], n).astype(float)
        y = [r.normal(size=n) * 10, r.integers(0, 4, n).astype(float), 0.25 * x + r.integers(0, 2, n)][seed // 3 % 3]
        assert robust.median_slope(x, y) == pytest.approx(listed(x, y), rel=1e-9, abs=1e-12)


def test_equal_samples():
    assert robust.median_slope(np.ones(500), np.arange(500.0)) == 0
    assert robust.median_slope(np.arange(3000.0), np.full(3000, 2.0)) == 0
    assert robust.median_slope(np.arange(3000.0), 0.1 * np.arange(3000.0)) == pytest.approx(0.1)
    assert robust.median_slope(np.zeros(0), np.zeros(0)) == 0


def test_a_hundred_thousand_samples_end():
    r = np.random.default_rng(1)
    x = np.sort(r.integers(0, 10**9, 100_000)).astype(float)
    began = time.time()
    assert robust.median_slope(x, 3e-4 * x + r.normal(size=len(x)) * 500) == pytest.approx(3e-4, rel=0.02)
    assert time.time() - began < 90


def test_fit_by_key(spark):
    rows = [(1, 0.0, 1.0), (1, 10.0, 6.0), (1, None, 3.0), (1, 20.0, 11.0), (2, 5.0, 7.0), (3, None, None), (None, 1.0, 1.0), (None, 2.0, 3.0)]
    got = {r["k"]: (r["n"], r["slope"], r["intercept"]) for r in clocks.theil_sen(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], "x", "y").collect()}
    assert got == {1: (3, 0.5, 1.0), 2: (1, 0.0, 7.0), None: (2, 2.0, -1.0)}


def test_clock_map_and_its_inverse(spark):
    rows = [(0, 0, 0.0), (1_700_000_000_000_000, 12_345_678, 1.5), (5, -400_000, -7.25), (0, 0, -3600.0)]
    d = spark.createDataFrame(rows, "start_us long, offset_us long, drift double").withColumn("video_us", F.explode(F.array(*map(F.lit, (0, 1, 999_999, 3_600_000_000, 40_000_000_000)))))
    wall = clocks.to_wall(F.col("start_us"), F.col("video_us"), F.col("offset_us"), F.col("drift"))
    for r in d.withColumn("wall", wall).withColumn("back", clocks.to_video(F.col("start_us"), F.col("wall"), F.col("offset_us"), F.col("drift"))).collect():
        if r["drift"] != -3600:
            assert r["back"] == r["video_us"]
    hour = d.where("video_us = 3600000000 and drift = 1.5").select((wall - F.col("start_us") - F.col("offset_us")).alias("w")).first()["w"]
    assert hour == 3_601_500_000


def test_many_groups_by_key(spark):
    """Small groups of all sizes, larger ones, ties of x and groups that span batches give the listed pairs' medians."""
    r = np.random.default_rng(4)
    sizes = [*range(1, 60), 2, 2, 1, 400, 1500]
    rows = [(g if g else None, float(a), float(b)) for g, n in enumerate(sizes) for a, b in zip(r.integers(0, max(1, n // 2), n), r.integers(0, 100, n))]
    points = spark.createDataFrame(rows, "k int, x double, y double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {x["k"]: (x["n"], x["slope"], x["intercept"]) for x in robust.fit_by_key(points, ["k"], "x", "y").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(sizes)
    for g, n in enumerate(sizes):
        mine = [(a, b) for k, a, b in rows if k == (g if g else None)]
        slope = listed(*zip(*mine))
        assert got[g if g else None] == (n, pytest.approx(slope, abs=1e-9), pytest.approx(float(np.median([b - slope * a for a, b in mine])), abs=1e-9))


def test_steps_of_a_merge(monkeypatch):
    monkeypatch.setattr(robust, "STEP", 16)
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 16, 33, 200):
        p = r.permutation(n)
        assert robust._inversions(p) == sum(a > b for a, b in itertools.combinations(p, 2))
