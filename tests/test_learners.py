"""Learned models held to metrics that DuckDB takes from written predictions, to bounds, and to what a fold may know."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle import connection
from tidegauge.operators import learners
from tidegauge.operators.features import Panel
from tidegauge.plans.catalogue import ORACLES, QUERIES
from tidegauge.plans.more import COLUMNS, FOLDS, KEYS, _panel, _summary

P = Panel(("entity",), ("d",))


@pytest.fixture(scope="module")
def panel(spark, sf):
    return _panel(spark, sf.replace("0.001", "0.01"))


def model(kind, **params):
    return lambda: learners.model(kind, COLUMNS, 3, **params)


LEARNERS = {"logistic": {}, "forest": {"numTrees": 5}, "boosted": {"maxIter": 3, "maxDepth": 2}, "perceptron": {"maxIter": 15}}


@pytest.mark.parametrize("kind", sorted(LEARNERS))
def test_predictions_score_as_duckdb_says_and_beat_the_commonest_class(spark, panel, tmp_path, kind):
    own = learners.walk_forward(panel, FOLDS, "event_date", model(kind, **LEARNERS[kind]), KEYS)
    own.write.parquet(f"{tmp_path}/p")
    kept = spark.read.parquet(f"{tmp_path}/p")
    got = {r.fold: (r.n, r.accuracy) for r in _summary(kept, "fold").collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW p AS SELECT * FROM '{tmp_path}/p/*.parquet'")
    want = {f: (n, a) for f, n, a in c.execute("SELECT fold, count(*), avg(CAST(label = prediction AS DOUBLE)) FROM p GROUP BY 1").fetchall()}
    assert got.keys() == want.keys() == {0, 1} and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1]) for k in want)
    common = c.execute("SELECT max(n) / sum(n) FROM (SELECT label, count(*) AS n FROM p GROUP BY 1)").fetchone()[0]
    n, hits = c.execute("SELECT count(*), avg(CAST(label = prediction AS DOUBLE)) FROM p").fetchone()
    assert hits >= common - 2 / math.sqrt(n)
    keys = {(r.entity, r.event_date) for r in panel.filter("event_date >= '1998-01-01' and event_date < '2003-01-01'").collect()}
    assert {(r.entity, r.event_date) for r in kept.collect()} == keys and n == len(keys)
    if kind != "boosted":
        loss, off = c.execute("SELECT avg(-ln(greatest(proba[CAST(label AS INTEGER) + 1], 2.3e-16))), max(abs(list_sum(proba) - 1)) FROM p").fetchone()
        assert loss < math.log(3) and off < 1e-6


def test_search_halves_to_the_winner_of_the_whole_grid(panel):
    names = learners.grid("logistic", COLUMNS, 3, {"regParam": [0.0001, 0.01, 1.0, 100.0]})
    whole, halved = (learners.search(panel, FOLDS, "event_date", names, KEYS, keep).collect() for keep in (1.0, 0.5))
    assert [r.folds for r in whole] == [2] * 4 and sorted(r.folds for r in halved) == [1, 1, 2, 2]
    assert halved[0].candidate == whole[0].candidate and math.isclose(halved[0].log_loss, whole[0].log_loss)
    assert [r.log_loss for r in whole] == sorted(r.log_loss for r in whole)


def test_samples_depend_on_their_seed():
    space = {"regParam": (1e-4, 1.0, "log"), "maxIter": (5, 9), "elasticNetParam": [0.0, 1.0]}
    of = lambda seed: list(learners.sampled("logistic", ["a"], 3, space, 6, seed))
    assert of(1) == of(1) != of(2) and len(of(1)) == 6
    names = [dict(x.split("=") for x in n.split(",")[1:]) for n in of(3)]
    assert all(1e-4 <= float(x["regParam"]) <= 1 and 5 <= int(x["maxIter"]) <= 9 and x["elasticNetParam"] in ("0", "1") for x in names)
    assert len(learners.sampled("logistic", ["a"], 3, {"maxIter": [3]}, 4)) == 1


def test_jobs_run_side_by_side_in_order_and_raise(spark):
    assert learners.at_once(spark, [lambda i=i: spark.range(i).count() for i in range(6)]) == list(range(6))
    with pytest.raises(ZeroDivisionError):
        learners.at_once(spark, [lambda: 1 / 0])


def test_forward_fill_around_a_fit_never_looks_at_test_rows(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    rows = [(1, day(0), None), (1, day(1), 5.0), (1, day(2), None), (1, day(3), None), (1, day(4), 8.0), (1, day(5), None), (2, day(0), None), (2, day(3), None), (2, day(4), 3.0), (3, day(4), None)]
    df = spark.createDataFrame(rows, "entity int, d date, x double")
    train, test = learners.forward_fills(P, ["x"])(df.filter(F.col("d") < day(3)), df.filter(F.col("d") >= day(3)))
    of = lambda x: [r.x for r in x.orderBy("entity", "d").collect()]
    assert of(train) == [5.0, 5.0, 5.0, 0.0] and of(test) == [5.0, 8.0, 8.0, 0.0, 3.0, 0.0] and test.columns == df.columns


def test_filled_folds_predict_every_row(panel):
    gaps = panel.withColumn("gap", F.when(F.col("gap") > 100, F.col("gap")))
    fill = learners.forward_fills(Panel(("entity",), ("event_date",)), ["gap"])
    own = learners.walk_forward(gaps, FOLDS, "event_date", model("logistic"), KEYS, prepare=fill)
    assert own.count() == panel.filter("event_date >= '1998-01-01' and event_date < '2003-01-01'").count()


def test_selection_takes_the_telling_feature_by_each_score(spark):
    rows = [(float(i % 3), float(i % 3) + 0.01 * (i % 7) if i % 11 else None, float((i * 7919) % 101), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "label double, good double, noise double, flat double")
    for by in ("correlation", "f", "information"):
        assert learners.selected(df, ["flat", "noise", "good"], "label", 1, by) == ["good"]
    assert learners.selected(df, ["flat", "noise", "good"], "label", 9, "correlation")[-1] == "flat"
    with pytest.raises(ValueError, match="no score"):
        learners.selected(df, ["good"], "label", 1, "luck")


@pytest.mark.parametrize("name", ["j16_campaign", "j18_stacking", "j19_selected_features", "j23_saved_model", "j11_holdout_refits", "j17_soft_vote"])
def test_fitted_plans_do_no_worse_than_the_commonest_class(spark, sf, name):
    sf = sf.replace("0.001", "0.01")
    sql = ORACLES["f1_class_shares"]
    common = max(r[2] for r in connection(sf).execute(sql).fetchall())
    rows = QUERIES[name](spark, sf).collect()
    n = sum(r.n for r in rows)
    hits = sum(r.n * r.accuracy for r in rows) / n
    assert hits >= common - 0.05 and all(0 <= r.accuracy <= 1 for r in rows)


def test_next_events_are_scored_once_for_every_customer(spark, sf):
    rows = QUERIES["j22_next_event"](spark, sf).collect()
    want = connection(sf).execute("SELECT count(DISTINCT o_custkey) FROM orders").fetchone()[0]
    assert len(rows) == want and all(r.choice in ("cut", "hike", "hold") and abs(sum(r.proba) - 1) < 1e-6 and r.gap_days > 0 for r in rows)


def test_sort_is_in_order(spark, sf):
    rows = QUERIES["g1_stable_sort"](spark, sf).collect()
    assert [r.l_shipdate for r in rows] == sorted(r.l_shipdate for r in rows) and len(rows) > 1000
