"""Errors, ties and nulls of the small operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import scalars
from tidegauge.operators import asof, baselines, calendars, evaluate, lexicon, quality, targets
from tidegauge.operators.features import Panel, eligible
from tidegauge.sources import ingest, sinks

D = dt.date.fromisoformat
LABELS = ["a", "b"]


def test_latest_snapshot_keeps_all_rows_of_the_last(spark):
    df = spark.createDataFrame([("x", 1, 1), ("x", 2, 2), ("x", 2, 3), ("y", None, 4)], "s string, snap int, v int")
    assert sorted(r.v for r in quality.latest_snapshot(df, ["s"], "snap").collect()) == [2, 3]


def test_unions_need_the_same_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(3, 4)], "v int, k int")
    assert sorted((r.source, r.k, r.v) for r in quality.union_of({"a": a, "b": b}).collect()) == [("a", 1, 2), ("b", 4, 3)]
    for frames in ({"a": a, "b": b.drop("v")}, {}):
        with pytest.raises(ValueError, match="columns|no frames"):
            quality.union_of(frames)


def test_enrichment_neither_loses_nor_multiplies(spark):
    df = spark.createDataFrame([(1, "p"), (2, "q"), (None, "r")], "k int, v string")
    other = spark.createDataFrame([(1, "one"), (9, "nine"), (9, "again")], "id int, name string")
    assert sorted((r.v, r.name) for r in asof.enriched(df, other, {"k": "id"}, ["name"]).collect()) == [("p", "one"), ("q", None), ("r", None)]
    with pytest.raises(Exception, match="several rows for 9"):
        asof.enriched(df.unionByName(spark.createDataFrame([(9, "s")], df.schema)), other, {"k": "id"}, ["name"]).collect()


def test_decisions_that_break_a_rule_end_the_job(spark):
    rows = [(1, D("2020-02-04"), D("2020-02-04"), "-0.25", "0.75"), (1, D("2020-03-03"), D("2020-03-03"), "0.1 to 0.2", "0.50")]
    kind = "entity int, observation_date date, publication_date date, change_raw string, new_rate_raw string"
    assert [(r.change_bps, r.new_rate, r.prior_rate) for r in targets.decisions(spark.createDataFrame(rows, kind), "2020-01-01").collect()] == [(-25, 0.75, 1.0)]
    for bad, match in (((1, D("2020-04-07"), D("2020-04-08"), "0.00", "0.5"), "published after"), ((1, D("2020-04-07"), None, "0.00", "0.5"), "publication_date is null"), ((1, D("2020-04-07"), D("2020-04-07"), "0.001", "0.5"), "add up")):
        with pytest.raises(Exception, match=match):
            targets.decisions(spark.createDataFrame([*rows, bad], kind), "2020-01-01").collect()


def test_rule_tables_raise_without_a_rule(spark):
    obs = spark.createDataFrame([("s", D("2020-01-31")), ("s", D("2020-12-31"))], "series_id string, observation_date date")
    rules = spark.createDataFrame([("s", 2, None, None, None, 1, "TUE", 1), ("s", 1, None, None, 12, 1, "FRI", -1)], "series_id string, priority int, since date, until date, month int, months_after int, weekday string, nth int")
    assert sorted(str(r.publication_date) for r in calendars.published_by_rule_table(obs, rules).collect()) == ["2020-02-04", "2021-01-29"]
    with pytest.raises(Exception, match="no rule for s"):
        calendars.published_by_rule_table(obs, rules.filter("priority = 1")).collect()
    with pytest.raises(Exception, match="no date after"):
        calendars.next_after(obs.select(F.col("observation_date").alias("d")), "2021-01-01").collect()


def test_spines(spark):
    days = spark.createDataFrame([(D("2020-01-31"),), (D("2020-05-02"),)], "d date")
    of = lambda step: [str(r.d) for r in calendars.spine(days, "d", step).orderBy("d").collect()]
    assert of("quarter") == ["2020-01-01", "2020-04-01"] and of("month")[-1] == "2020-05-01" and len(of("weekday")) == 66 and of("week")[0] == "2020-01-27"
    assert calendars.spine(days.limit(0), "d", "month").count() == 0


def test_windows_include_both_ends_and_eras_only_the_first(spark):
    days = spark.createDataFrame([(D(x),) for x in ("2019-12-31", "2020-01-01", "2020-02-01", "2020-02-02")] + [(None,)], "d date")
    flags = days.select("d", *scalars.regimes(F.col("d"), {"e": ("2020-01-01", "2020-02-01")}, {"w": ("2020-01-01", "2020-02-01")}, {"s": "2020-02-02"})).orderBy(F.asc_nulls_last("d")).collect()
    assert [(r.regime_e, r.regime_w, r.regime_s) for r in flags] == [(0, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)]


def test_classes_by_weight(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("a", None), (None, 9.0)], "y string, w double")
    assert [(r.y, r.n, r.share, r.is_majority) for r in evaluate.class_shares(df, "y", "w").orderBy("y").collect()] == [("a", 2, 0.5, 1), ("b", 1, 0.5, 0)]
    assert evaluate.class_shares(df.limit(0), "y").count() == 0


def test_reports_without_pairs(spark):
    df = spark.createDataFrame([(1, "a", "a", None), (2, "b", "a", "b"), (2, "b", "b", "a")], "fold int, y_true string, y_pred string, m string")
    got = {(r.fold, r.is_overall): (r.n, r.accuracy, r.n_paired, r.market_hit_rate, r.lift) for r in evaluate.run_report(df, LABELS, "x", market="m").collect()}
    assert got == {(1, 0): (1, 1.0, 0, None, None), (2, 0): (2, 0.5, 2, 0.5, 0.0), (None, 1): (3, 2 / 3, 2, 0.5, 0.0)}


def test_eligible_leaves_companions_and_flags(spark):
    df = spark.createDataFrame([(1.0, 1, 0, 1, 2.0)], "v double, v_age_days int, v_is_missing int, regime_x int, id double")
    with pytest.warns(UserWarning, match="regime_x"):
        assert eligible(df, df.columns, ("id",)) == ["v"]


def test_speakers(spark):
    lines = [("Jo Ray AC Deputy Governor",), ("Head of Nothing",), ("  ",), (None,), ("A B [ * ] Head of Payments *",)]
    own = ingest.speaker_and_role(F.col("t"))
    got = [(r.speaker, r.role) for r in spark.createDataFrame(lines, "t string").select(own["speaker"].alias("speaker"), own["role"].alias("role")).collect()]
    assert got == [("Jo Ray", "Deputy Governor"), ("Head of Nothing", None), (None, None), (None, None), ("A B", "Head of Payments")]


def test_sources_without_columns_are_left_out(spark):
    words = spark.createDataFrame([("good", "positive"), ("bad", "negative")], "word string, category string")
    docs = spark.createDataFrame([(1, "Good good bad", 3), (2, None, 4), (2, None, 4)], "id int, body string, at int")
    with pytest.warns(UserWarning, match="other"):
        out = lexicon.scores_of_sources({"docs": docs, "other": docs.drop("at")}, words, ["positive", "negative"], "id", "body", "at").orderBy("id").collect()
    assert [(r.source, r.id, r.n_tokens, r.positive, r.negative) for r in out] == [("docs", 1, 3, 2, 1), ("docs", 2, 0, 0, 0), ("docs", 2, 0, 0, 0)] and out[1].tone is None
    with pytest.raises(ValueError, match="no source"), pytest.warns(UserWarning):
        lexicon.scores_of_sources({"other": docs.drop("at")}, words, ["positive"], "id", "body", "at")


def test_empty_frames_keep_their_columns(spark):
    none = spark.createDataFrame([], "year int, v double, entity long")
    assert sinks.write_frame(none, sinks.workspace(spark, "none"), ["year"]).schema == none.schema
    assert sinks.write_bucketed(none, sinks.workspace(spark, "none"), ["entity"], 4).columns == ["year", "v", "entity", "bucket"]


def test_targets_need_links_in_the_window(spark):
    df = spark.createDataFrame([(1, D("2020-01-01"), "x"), (2, D("2020-01-02"), " "), (3, D("2020-01-03"), None), (4, None, "x"), (5, D("2021-01-01"), "x")], "k int, at date, link string")
    window = spark.createDataFrame([(D("2020-01-01"), D("2020-12-31"))], "since date, until date")
    assert [r.k for r in ingest.in_window(df, "at", window, "link").collect()] == [1]
    assert [r.t for r in df.select(baselines.is_test(F.col("at"), "2020-01-03").alias("t")).collect()] == [0, 0, 1, None, 1]


def test_spine_knows_what_came_before_its_first_day(spark):
    df = spark.createDataFrame([(1, D("2020-01-01"), 5.0), (1, D("2020-02-01"), 6.0)], "entity int, d date, v double")
    got = targets.event_spine(df, Panel(("entity",), ("d",)), "d", "v", "2020-02-01", ("url",)).collect()
    assert [(r.prior_value, r.gap_days, r.url) for r in got] == [(5.0, 31, None)]


def test_digests_tell_contents_and_not_their_order(spark):
    rows = [(i, D("2020-01-01") + dt.timedelta(days=i), float(i) if i % 3 else None) for i in range(50)]
    of = lambda own, parts: quality.manifest(spark.createDataFrame(own, "k int, d date, v double").repartition(parts), "d").collect()[0].asDict()
    assert of(rows, 1) == of(rows[::-1], 7)
    assert of(rows, 1) != of([*rows[:-1], (49, rows[49][1], 0.5)], 1) and of(rows, 2) != of([*rows, rows[0]], 2)
