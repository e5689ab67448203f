"""Quantiles, ranks and information over many small ranges, against numpy and direct sums."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import evaluate, information, ranges


@pytest.fixture(autouse=True)
def small_ranges(monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 9)


def test_quantiles_of_groups_and_nulls(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([None, rng.random(), 0.5, 7.0]), float(g) if rng.random() < 0.5 else None, None) for g in range(3) for _ in range(60 * g + 1)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double")
    got = {(r.g, r.feature, r.share): r.value for r in ranges.quantiles(df, ["a", "b", "c"], [0.0, 0.13, 0.5, 1.0], ["g"]).collect()}
    want = {}
    for g in range(3):
        for i, f in ((1, "a"), (2, "b")):
            own = [r[i] for r in rows if r[0] == g and r[i] is not None]
            want |= {(g, f, q): np.quantile(own, q) for q in (0.0, 0.13, 0.5, 1.0) if own}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    assert ranges.quantiles(df.limit(0), ["a"], [0.5]).count() == 0


def test_mid_ranks(spark):
    values = [1.0, 1.0, 2.0, 5.0, 5.0, 5.0, *[float(i) for i in range(10, 60)]]
    counts = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("f", F.lit("x"))
    got = {r.v: r["rank"] for r in ranges.mid_ranks(counts, ["f"], "v").collect()}
    assert got == {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in values}


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def estimate(x, y, k=3, least=30):
    """The neighbour estimate by comparing all pairs."""
    pairs = [(a, b) for a, b in zip(x, y) if a is not None and b is not None]
    if len(pairs) < least:
        return None
    if len({a for a, _ in pairs}) == 1:
        return 0.0
    size = {b: sum(c == b for _, c in pairs) for _, b in pairs}
    own = [(a, b) for a, b in pairs if size[b] > 1]
    total = 0.0
    for i, (a, b) in enumerate(own):
        near = min(k, size[b] - 1)
        d = sorted(abs(a - c) for j, (c, e) in enumerate(own) if e == b and j != i)[near - 1]
        m = sum(c == a for c, _ in own) if d == 0 else sum(a - d < c < a + d for c, _ in own)
        total += psi(sum(c == (a, b) for c in own) if d == 0 else near) - psi(size[b]) - psi(m)
    return max(0.0, psi(len(own)) + total / len(own))


def test_continuous_information_is_that_of_all_pairs(spark):
    rng = random.Random(2)
    y = [rng.choice("aabbc") for _ in range(150)] + ["alone", None, "two", "two"]
    told = {
        "near": [ord(v[0]) + rng.gauss(0, 1) if v else 0.3 for v in y],
        "ties": [float(rng.randrange(6)) if v != "two" else 0.25 for v in y],
        "whole": [float(rng.randrange(3)) for _ in y],
        "gaps": [rng.random() if rng.random() < 0.5 else None for _ in y],
        "flat": [2.0] * len(y),
        "few": [rng.random() if i < 20 else None for i in range(len(y))],
        "none": [None] * len(y),
    }
    df = spark.createDataFrame([(v, *row) for v, row in zip(y, zip(*told.values()))], "y string, " + ", ".join(f"{c} double" for c in told))
    got = {r.feature: r.mi for r in information.continuous_information(df, list(told), "y").collect()}
    assert set(got) == set(told) - {"none"}
    for c in got:
        want = estimate(told[c], y)
        assert got[c] is None if want is None else math.isclose(got[c], want, abs_tol=1e-9), c
    assert information.discrete_features(df, list(told)) == ["flat", "ties", "whole"] if all(v != 0.25 for v in told["ties"]) else ["flat", "whole"]
    every = {r.feature: r.mi for r in information.information(df, ["near", "whole"], "y").collect()}
    assert math.isclose(every["near"], got["near"]) and every["whole"] < 0.1 < every["near"]


def test_correlations_with_gaps_are_those_of_the_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.random() if rng.random() < 0.9 else None, rng.choice([1.0, 2.0, 2.0]), rng.random() if rng.random() < 0.7 else None, 4.0) for _ in range(120)]
    df = spark.createDataFrame(rows, "t double, full double, gaps double, flat double")
    got = {r.feature: r for r in evaluate.associations(df, ["full", "gaps", "flat"], "t").collect()}

    def ranked(v):
        return [sum(x < a for x in v) + (v.count(a) + 1) / 2 for a in v]

    for i, c in ((1, "full"), (2, "gaps")):
        x, t = zip(*[(r[i], r[0]) for r in rows if r[i] is not None and r[0] is not None])
        assert got[c].n_obs == len(x) and math.isclose(got[c].pearson, np.corrcoef(x, t)[0, 1]) and math.isclose(got[c].spearman, np.corrcoef(ranked(list(x)), ranked(list(t)))[0, 1])
    assert got["flat"].pearson is None and got["flat"].spearman is None
    assert [tuple(r) for r in evaluate.associations(df.limit(0), ["gaps"], "t").collect()] == [("gaps", 0, None, None)]


def test_bundle_over_all_is_not_a_group_of_nulls(spark):
    rows = [("x", "a", "a"), ("x", "b", "a"), (None, "a", "a"), (None, "b", "b"), (None, "a", "c")]
    df = spark.createDataFrame(rows, "fold string, y_true string, y_pred string")
    got = {(r.fold, r.is_overall): (r.n, r.accuracy, r.balanced_accuracy) for r in evaluate.bundle(df, ["a", "b", "c"], ["fold"]).collect()}
    assert got == {("x", 0): (2, 0.5, 0.5), (None, 0): (3, 2 / 3, 0.75), (None, 1): (5, 0.6, (2 / 3 + 0.5) / 2)}
