"""What the findings of round 3 were about, on small tables that showed it."""

import pytest

from oracle import same
from tidegauge.operators import evaluate, information, learners, neighbours, ranges
from tidegauge.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["b2_checked_decisions", "b2_decisions"])
def test_f1_f2_halves_of_the_last_digit_round_as_in_sql(spark, tmp_path, name):
    spark.sql("SELECT id AS o_orderkey, id % 7 AS o_custkey, 500.0D + 1000 * ((id * 7919) % 400) AS o_totalprice, timestamp'1995-06-01' + make_dt_interval(CAST(id AS int)) AS o_orderdate FROM range(2000)").toPandas().to_parquet(f"{tmp_path}/orders.parquet", coerce_timestamps="us")
    same(QUERIES[name](spark, str(tmp_path)), ORACLES[name], str(tmp_path))


@pytest.mark.parametrize(("rows", "most"), [(500_000, 200_000), (50, 200_000), (50, 0)])
def test_f3_f6_only_cells_at_the_ends_of_ranges_are_looked_at_across_them(spark, sf, monkeypatch, rows, most):
    made, scanned, placed = information.written, [], []
    monkeypatch.setattr(ranges, "RANGE_ROWS", rows)
    monkeypatch.setattr(ranges, "MOST_BROADCAST", most)
    monkeypatch.setattr(information, "written", lambda df, label: (scanned.append(made(df, label)), scanned[-1])[1] if label == "open" else made(df, label))
    monkeypatch.setattr(information, "in_ranges", lambda *a: (placed.append(1), ranges.in_ranges(*a))[1])
    same(QUERIES["f18_continuous"](spark, sf), ORACLES["f18_continuous"], sf)
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert bool(placed) == (not most) and scanned[0].count() <= 2 * 3 * 3 * 5 * (1 + 2 * n // rows)  # neighbours, sides, classes, features


@pytest.mark.parametrize("name", ["h6_scores_of_sources", "h3_h6_lexicon_scores"])
def test_f4_words_are_not_sorted_to_be_counted(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_f5_votes_are_summed_a_row_a_member_without_lists(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "k int, label double, proba array<double>")
    first, second = rows((1, 0.0, [0.5, 0.5]), (2, 1.0, [0.25, 0.75]), (3, 1.0, None), (4, 0.0, [1.0])), rows((1, 0.0, [0.25, 0.25, 0.5]), (2, 1.0, [1.0, 0.0]), (5, 0.0, []))
    for n in (None, 3):
        out = learners.soft_vote([first, second], ["k"], [1.0, 3.0], **({"n_classes": n} if n else {}))
        assert {r.k: (r.proba, r.prediction) for r in out.collect()} == {1: ([0.3125, 0.3125, 0.5], 2.0), 2: ([0.8125, 0.1875], 0.0), 4: ([1.0], 0.0)}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "collect_list" not in plan


def test_f8_a_campaign_fits_each_candidate_once_a_fold(spark, sf, monkeypatch):
    fit, own = learners.fold_predictions, []
    monkeypatch.setattr(learners, "fold_predictions", lambda *a, **k: (own.append(1), fit(*a, **k))[1])
    rows = QUERIES["j16_campaign"](spark, sf).collect()
    assert len(rows) == 2 and len(own) == 2 * (2 + 2)


def test_f7_blocks_are_searched_as_matrices(spark):
    df = spark.range(40).selectExpr("'a' AS g", "CAST(id AS string) AS k", "array(CAST(id % 20 AS double), 0.0D) AS x")
    found = neighbours.near_rows(df, "g", "k", "x", 2, 2, first=1.0)
    assert "CoGroupsInArrow" in found._jdf.queryExecution().toString() and "CoGroupsInPandas" not in found._jdf.queryExecution().toString()
    got = {r.k: [(n.distance, n.k) for n in r.near] for r in found.collect()}
    want = {str(i): sorted((float(abs(i % 20 - j % 20)), str(j)) for j in range(40) if j != i)[:2] for i in range(40)}
    assert got == want


def test_f6_cells_are_counted_once_and_nothing_is_ranked_for_pearson(spark, sf, monkeypatch):
    labels, made = [], information.written
    monkeypatch.setattr(information, "written", lambda df, label: (labels.append(label), made(df, label))[1])
    for module in (evaluate, ranges):
        monkeypatch.setattr(module, "written", lambda df, label: pytest.fail(f"{label} are not asked for"))
    for name in ("f19_ranked_by_information", "f19_ranked_features"):
        same(QUERIES[name](spark, sf), ORACLES[name], sf)
    assert labels.count("cells") == 1
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert "lineitem" not in information.information(rows, ["l_linenumber", "l_quantity"], "l_returnflag")._jdf.queryExecution().toString()  # all is told from the cells


def test_f6_information_is_that_of_each_kind_of_feature(spark):
    label = "CASE WHEN id % 11 = 0 THEN NULL WHEN id = 5 THEN 'alone' ELSE chr(CAST(97 + id % 3 AS int)) END AS y"
    df = spark.sql(f"SELECT {label}, id % 4 AS few, -0.0D * (id % 2) AS zeros, IF(id % 11 = 0, 1, NULL) AS unlabelled, (id % 3) * 6 + id % 5 AS spread, IF(id % 7 = 0, NULL, sin(id)) AS gaps, CAST(NULL AS double) AS none FROM range(300)")  # spread: at most ten values a class, more in all
    discrete, rest = ["few", "unlabelled", "zeros"], ["spread", "gaps", "none"]
    assert information.discrete_features(df, [*discrete, *rest]) == discrete
    told = lambda out: {r.feature: r.mi for r in out.collect()}
    for features in ([*rest, *discrete], discrete, rest):
        want = told(evaluate.mutual_information(df, [c for c in features if c in ("few", "unlabelled")], "y")) if "few" in features else {}
        want |= {"zeros": 0.0} if "zeros" in features else {}
        want |= told(information.continuous_information(df, rest, "y")) if "gaps" in features else {}
        got = told(information.information(df, features, "y"))
        assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], abs=1e-12) for c in want)
        assert told(information.information(df.limit(0), features, "y")) == {}
