"""Tiled features against the plain ones, fold statistics against expanded folds, linear rules against least squares, and no row that looks ahead."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import asof, baselines, features, tiles
from tidegauge.operators.features import Panel

P = Panel(("entity",), ("d",))
START = dt.date(2020, 1, 1)


def panel(spark, seed=1, sizes=(1, 7, 90, 0, 33)):
    rng = random.Random(seed)
    rows = []
    for e, n in enumerate(sizes):
        for i in range(n):
            gap = 20 <= i < 65 and e == 2  # longer than the reach of an exponential mean's tiles
            rows.append((e, START + dt.timedelta(days=3 * i), None if gap or rng.random() < 0.15 else round(rng.uniform(-5, 90), 2), rng.choice("ab")))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "entity int, d date, v double, y string")


def by_row(df):
    return {(r.entity, r.d): r.asDict() for r in df.collect()}


def alike(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].keys() == b[k].keys()
        for c in a[k]:
            x, y = a[k][c], b[k][c]
            assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) and isinstance(y, float) else x == y, (k, c, x, y)


@pytest.mark.parametrize(("size", "in_range"), [(4, 11), (13, 1000), (1000, 5)])
def test_tiles_change_nothing(spark, size, in_range):
    df = panel(spark)
    want = df.select("*", *features.lags(P, ["v"], (1, 2, 7)), *features.rolling(P, ["v"], (3, 5)), *features.changes(P, ["v"], (1, 3), (2,)), features.trend_gap(P, "v", 9).alias("gap"))
    want = want.withColumn("filled", features.forward_filled(P, "v", F.lit(-1.0)))
    for span in (1, 3, 6):
        want = features.ewma(want, P, "v", span) if span > 1 else want.withColumn("v_ewma_1", F.last("v", ignorenulls=True).over(P.so_far))
    t = tiles.Tiled.of(df, P, size, in_range).lags(["v"], (1, 2, 7)).rolling(["v"], (3, 5)).changes(["v"], (1, 3), (2,)).trend_gap("v", "gap", 9).forward_filled("v", "filled", F.lit(-1.0))
    for span in (1, 3, 6):
        t = t.ewma("v", span)
    alike(by_row(t.rows.select(*want.columns)), by_row(want))


def test_empty_panel(spark):
    none = panel(spark).limit(0)
    t = tiles.Tiled.of(none, P).lags(["v"], (1,)).ewma("v", 3).forward_filled("v", "f")
    assert t.rows.count() == 0 and t.rows.columns == ["entity", "d", "v", "y", "v_lag_1", "v_ewma_3", "f"]


@pytest.mark.parametrize("rolling", [None, 3])
def test_fold_statistics_are_those_of_members(spark, rolling):
    df = panel(spark)
    folds = baselines.folds(df, ["entity"], 5, 2, 3, rolling)
    own = baselines.members(baselines.positions(df, ["entity"], ["d"]), folds, ["entity"]).groupBy("entity", "fold", "is_test")
    want = own.agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("v_n"), F.avg("v").alias("v_mean"), F.var_samp("v").alias("v_var"), F.sum((F.col("y") == "a").cast("int")).alias("y_a"), F.sum((F.col("y") == "b").cast("int")).alias("y_b"))
    got = tiles.fold_statistics(df, P, folds, ["v"], {"y": ["a", "b"]}, 6, 9)
    key = lambda x: {(r.entity, r.fold, r.is_test): r.asDict() for r in x.collect()}
    a, b = key(got), key(want.select(*got.columns))
    assert a.keys() == b.keys() and len(a) > 40
    for k in a:
        assert all(x == y or x is not None and y is not None and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6) for x, y in zip(a[k].values(), b[k].values(), strict=True)), (a[k], b[k])


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_policy_rule_is_least_squares(spark, k, weighted):
    rng = random.Random(k)
    rows = [(1, START + dt.timedelta(days=i), *[rng.choice([None, *[rng.uniform(5, 9) for _ in range(6)]]) for _ in range(3)], rng.choice([None, 3e5, 3.1e5, 3.3e5]), rng.choice([None, 0.0, 1.0, 2.5, 0.5])) for i in range(40)]
    xs = ["a", "b", "c"][:k]
    df = spark.createDataFrame(rows, "entity int, d date, a double, b double, c double, y double, w double")
    got = baselines.policy_rule(df, P, xs, "y", "w" if weighted else None).orderBy("d").collect()
    told = 0
    for i, r in enumerate(got):
        use = [q for q in got[:i] if all(q[c] is not None for c in (*xs, "y")) and (not weighted or q.w)]
        if len(use) < k + 1:
            assert r.intercept is None and r.prescribed is None
            continue
        if len(use) < k + 4:
            continue  # nearly dependent
        root = np.sqrt([q.w if weighted else 1.0 for q in use])
        want = np.linalg.lstsq(np.array([[1.0, *[q[c] for c in xs]] for q in use]) * root[:, None], np.array([q.y for q in use]) * root, rcond=None)[0]
        assert np.allclose([r.intercept, *[r[f"slope_{c}"] for c in xs]], want, rtol=1e-6)
        if all(r[c] is not None for c in xs):
            assert math.isclose(r.prescribed, want[0] + sum(b * r[c] for b, c in zip(want[1:], xs)), rel_tol=1e-7)
            told += 1
    assert told > 5


def test_regressors_that_hang_together_give_nothing(spark):
    rows = [(1, START + dt.timedelta(days=i), float(i), 2.0 * i + 1, float(i % 3)) for i in range(9)]
    df = spark.createDataFrame(rows, "entity int, d date, a double, b double, y double")
    assert {r.slope_a for r in baselines.policy_rule(df, P, ["a", "b"], "y").collect()} == {None}
    calls = df.select(baselines.direction(F.col("y"), F.lit(1.0)).alias("c"), baselines.given_rule({"a": 2.0, "b": -1.0}, 4.0).alias("g")).collect()
    assert [r.c for r in calls[:3]] == ["cut", "hold", "hike"] and {r.g for r in calls} == {3.0}


def everything(df):
    """All features of the library along a panel, as of each of its rows."""
    lagged = df.select("*", *features.lags(P, ["v", "v2"]), *features.rolling(P, ["v"], (3, 6)), *features.changes(P, ["v"]), features.year_on_year(P, "v", "d").alias("yoy"), features.cycle_phase(P, "v").alias("phase"), features.trend_gap(P, "v").alias("gap"), *features.since_previous(P, "d", "v"))
    pick, shares = baselines.majority_so_far(P, "y", ["a", "b"])
    out = lagged.select("*", pick.alias("majority"), shares["a"].alias("share_a"), baselines.persistence(P, "y").alias("last_y"), features.forward_filled(P, "v").alias("filled"))
    out = features.ewma(out, P, "v", 6)
    out = baselines.policy_rule(out, P, ["v2"], "v")
    t = tiles.Tiled.of(out, P, 7, 20).lags(["v2"], (4,)).rolling(["v2"], (4,), ("mean",)).ewma("v2", 4).forward_filled("v2", "filled2")
    obs = df.select("entity", F.col("y").alias("series_id"), F.col("d").alias("observation_date"), F.date_add("d", F.lit(1)).alias("publication_date"), F.col("v").alias("value"))
    spine = df.select("entity", F.col("d").alias("event_date"))
    seen = asof.as_of(spine, obs, ["entity"])
    near = asof.as_of(spine, obs, ["entity"], within_days=9, bucket_days=30).withColumnsRenamed({"value": "near", "age_days": "near_age", "is_missing": "near_missing"})
    wide = asof.assemble_wide(spine, obs, ["entity"], ["a", "b"])
    return t.rows.withColumnRenamed("d", "event_date").join(seen, ["entity", "event_date"]).join(near, ["entity", "event_date"]).join(wide, ["entity", "event_date"]).withColumnRenamed("event_date", "d")


@pytest.mark.parametrize("seed", [1, 2])
def test_later_rows_never_change_earlier_features(spark, seed):
    rng = random.Random(seed)
    df = panel(spark, seed, (60, 41, 12, 150)).withColumn("v2", F.col("v") * 2 + F.day("d")).orderBy("entity", "d")
    cut = START + dt.timedelta(days=rng.randrange(30, 170))
    later = F.col("d") >= F.lit(cut)
    other = df.withColumns({"v": F.when(later, 9_999_999.0).otherwise(F.col("v")), "v2": F.when(later, -1.0).otherwise(F.col("v2")), "y": F.when(later, "b").otherwise(F.col("y"))}).filter(~later | (F.rand(seed) < 0.7))
    a, b = (by_row(everything(x).filter(~later)) for x in (df, other))
    assert len(a) > 40 and len(next(iter(a.values()))) > 50
    alike(a, b)
