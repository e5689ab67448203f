"""Hand-computed values, leakage, nulls and ties."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import scalars
from tidegauge.operators import asof, baselines, calendars, evaluate, features, lexicon, quality
from tidegauge.operators.features import Panel
from tidegauge.sources import ingest

D = dt.date.fromisoformat
P = Panel(("entity",), ("d",))
LONG = "entity int, series_id string, observation_date date, publication_date date, value double"


def spine(spark, *days):
    return spark.createDataFrame([(1, D(x)) for x in days], "entity int, event_date date")


def obs(spark, *rows):
    return spark.createDataFrame([(1, "s", D(o), p and D(p), v) for o, p, v in rows], LONG)


def joined(df):
    return [(r.value, r.age_days, r.is_missing) for r in df.orderBy("event_date").collect()]


def test_same_day_publication_is_hidden(spark):
    o = obs(spark, ("2019-12-01", "2019-12-15", 1.0), ("2019-12-31", "2020-01-01", 99.0))
    s = spine(spark, "2020-01-01")
    assert joined(asof.as_of(s, o, ["entity"])) == [(1.0, 17, 0)]
    assert joined(asof.as_of(s, o, ["entity"], strict=False)) == [(99.0, 0, 0)]


def test_latest_row_counts_even_if_null_and_unpublished_never(spark):
    o = obs(spark, ("2020-01-01", "2020-01-02", 1.0), ("2020-02-01", "2020-02-02", None), ("2020-02-03", None, 7.0))
    assert joined(asof.as_of(spine(spark, "2020-01-01", "2020-01-03", "2020-02-05"), o, ["entity"])) == [(None, None, 1), (1.0, 1, 0), (None, 3, 1)]


def test_ties_in_publication_take_latest_observation_then_largest_value(spark):
    o = obs(spark, ("2020-01-03", "2020-01-07", 3.0), ("2020-01-06", "2020-01-07", 6.0), ("2020-01-06", "2020-01-07", 5.0))
    assert joined(asof.as_of(spine(spark, "2020-01-08"), o, ["entity"])) == [(6.0, 1, 0)]


@pytest.mark.parametrize("bucket", [1, 10, 1000])
def test_buckets_change_nothing(spark, bucket):
    days = [D("2020-01-01") + dt.timedelta(days=3 * i) for i in range(40)]
    o = spark.createDataFrame([(i % 2, "s", d, d + dt.timedelta(days=i % 5), None if i % 7 == 0 else float(i)) for i, d in enumerate(days)], LONG)
    s = spark.createDataFrame([(e, D("2020-01-01") + dt.timedelta(days=i)) for e in (0, 1, 2) for i in range(130)], "entity int, event_date date")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(asof.as_of(s, o, ["entity"])) == key(asof.as_of(s, o, ["entity"], bucket_days=bucket))


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="value"):
        asof.check_long(spark.range(1).select(F.lit("s").alias("series_id"), F.lit(None).alias("observation_date"), F.lit(None).alias("publication_date")))


def panel(spark, values, start="2020-01-01", step=1):
    return spark.createDataFrame([(1, D(start) + dt.timedelta(days=step * i), v) for i, v in enumerate(values)], "entity int, d date, v double")


def column(df, c):
    return [r[c] for r in df.orderBy("d").collect()]


def test_rolling_needs_all_values_and_flat_windows_have_no_score(spark):
    df = panel(spark, [1.0, 2.0, 3.0, None, 5.0, 5.0, 5.0])
    out = df.select("d", *features.rolling(P, ["v"], (3,)))
    assert column(out, "v_roll_3_mean") == [None, None, 2.0, None, None, None, 5.0]
    assert column(out, "v_roll_3_std") == [None, None, 1.0, None, None, None, 0.0]
    assert column(out, "v_roll_3_zscore") == [None, None, 1.0, None, None, None, None]


def test_year_on_year_by_calendar(spark):
    df = spark.createDataFrame([(1, D(d), v) for d, v in [("2023-01-01", 100.0), ("2023-06-01", 110.0), ("2024-01-01", 120.0), ("2024-06-01", 132.0)]], "entity int, d date, v double")
    got = column(df.select("d", features.year_on_year(P, "v", "d").alias("y")), "y")
    assert got[:2] == [None, None] and got[2:] == pytest.approx([0.2, 0.2])


def test_ewma_is_pandas_s(spark):
    import pandas as pd

    values = [None, 1.0, 2.0, None, None, 4.0, 3.0, None, 8.0]
    want = pd.Series(values).ewm(span=3, adjust=True).mean()
    got = column(features.ewma(panel(spark, values), P, "v", 3), "v_ewma_3")
    assert [None if x is None else round(x, 12) for x in got] == [None if math.isnan(x) else round(x, 12) for x in want]


def test_later_rows_change_nothing_earlier(spark):
    def build(df):
        df = features.ewma(df, P, "v", 3)
        return df.select("d", "v_ewma_3", *features.lags(P, ["v"]), *features.rolling(P, ["v"]), *features.changes(P, ["v"]), features.year_on_year(P, "v", "d").alias("yoy"), features.forward_filled(P, "v").alias("f"), features.cycle_phase(P, "v").alias("c"), features.trend_gap(P, "v").alias("g"))

    values = [float(i * i % 17) for i in range(20)]
    before = build(panel(spark, values, step=40)).orderBy("d").collect()
    after = build(panel(spark, [*values, 9_999_999.0], step=40)).orderBy("d").collect()
    assert before == after[:-1]


def test_splice_scales_the_old_index(spark):
    old, new = panel(spark, [1.0, 2.0, 4.0]), panel(spark, [8.0, 9.0], "2020-01-03")
    assert column(features.spliced(old, new, ["entity"], "d", "v"), "v") == [2.0, 4.0, 8.0, 9.0]


def test_future_row_only_after_the_last(spark):
    df = panel(spark, [1.0, 2.0])
    assert features.append_future(df, P, "d", "v", "2020-01-02").count() == 2
    row = features.append_future(df, P, "d", "v", "2020-01-05").orderBy(F.desc("d")).first()
    assert (row.v, row.previous_value, row.gap_days) == (None, 2.0, 3)


@pytest.mark.parametrize("text,want", [("-0.25", -0.25), ("+0.25", 0.25), ("−1.5", -1.5), ("15.00 to 15.50", None), ("n/a", None), (" 0.00 ", 0.0), (None, None)])
def test_signed_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(scalars.signed_number(F.col("t"))).first()[0] == want


def test_calendar_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    day = lambda x: F.lit(x).cast("date")
    assert [one(calendars.nth_weekday(day("2024-03-15"), "THU", n)) for n in (1, 2, 3, 4)] == [D(f"2024-03-{x:02}") for x in (7, 14, 21, 28)]
    assert one(calendars.labour_release(day("1995-12-31"))) == D("1996-01-25")
    assert one(calendars.labour_release(day("2010-12-31"))) == D("2011-01-27")
    assert one(calendars.labour_release(day("2020-12-31"))) == D("2021-01-28")
    assert one(calendars.easter(F.lit(2024))) == D("2024-03-31") and one(calendars.easter(F.lit(1961))) == D("1961-04-02")
    assert one(calendars.second_after(day("2024-03-05"), "TUE")) == D("2024-03-19")
    with pytest.raises(ValueError):
        calendars.nth_weekday(day("2024-03-15"), "THU", 5)


def test_metrics_by_hand(spark):
    rows = [("cut", "cut")] * 1 + [("cut", "hold")] * 2 + [("hike", "hike")] * 11 + [("hike", "hold")] * 5 + [("hold", "hold")] * 17 + [("hold", "hike")] * 3
    df = spark.createDataFrame(rows, "y_true string, y_pred string")
    got = evaluate.classification(df, ["cut", "hike", "hold"], []).first()
    assert (got.n, round(got.accuracy, 4), round(got.balanced_accuracy, 4)) == (39, 0.7436, 0.6236)
    assert evaluate.confusion(df, ["cut", "hike", "hold"]).filter("y_true = 'cut'").first()[1:] == (1, 0, 2)


def test_bins_by_their_very_edges(spark):
    df = spark.createDataFrame([(0.3, 1), (1.0, 0), (0.0, 1)], "p double, hit int")
    edges = [i / 10 for i in range(10)] + [1.0]
    edges[3] = 0.30000000000000004
    got = {r.bin: r.n for r in evaluate.reliability(df, "p", "hit", edges).collect()}
    assert got[2] == 1 and got[3] == 0 and got[9] == 1 and got[0] == 1 and len(got) == 10


def test_first_label_wins_ties(spark):
    proba = {"hold": F.lit(0.5), "cut": F.lit(0.5), "hike": F.lit(0.0)}
    assert spark.range(1).select(baselines.first_best(proba)).first()[0] == "cut"


def test_lexicon_of_empty_text(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Good, good bad GOOD"), (4, "good"), (4, "bad bad"), (4, "bad")], "doc_id int, text string")
    lex = spark.createDataFrame([("good", "positive"), ("bad", "negative")], "word string, category string")
    every = lexicon.scores(lexicon.category_counts(docs, lex, ["positive", "negative"]), ["positive", "negative"]).collect()
    assert sorted((r.n_tokens, r.positive, r.negative) for r in every if r.doc_id == 4) == [(1, 0, 1), (1, 1, 0), (2, 0, 2)]
    rows = {r.doc_id: r for r in every}
    assert rows[1].tone is None and rows[2].positive_per_1000 == 0 and rows[3].positive == 3 and rows[3].tone == 0.5


def test_reconciliation(spark):
    f = lambda *x: spark.createDataFrame([(v,) for v in x], "k int")
    got = sorted(map(tuple, quality.reconciled(f(1, 2, 3), f(2, 2, 4), "k", f(3)).collect()))
    assert got == [(1, "missing"), (2, "duplicate"), (4, "extra")]


def test_wide_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Yields,,\nSeries ID,A1,B2\n20-May-2013,1.5,n/a\n21/05/2013,,2.5\nnote,,\n")
    got = sorted(map(tuple, ingest.read_wide_csv(spark, str(tmp_path / "x.csv")).collect()))
    assert got == [("A1", D("2013-05-20"), 1.5), ("B2", D("2013-05-21"), 2.5)]


def test_plans_use_no_python_and_no_cartesian_product(spark, sf):
    from tidegauge.plans.catalogue import QUERIES

    for name in ("d1_asof_strict", "d5_wide_assembly", "e5_ewma", "h3_h6_lexicon_scores"):
        text = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "Python" not in text, name


def test_splice_checks_growth(spark):
    old, new = (spark.createDataFrame([(1, D(d), v) for d, v in rows], "entity int, d date, value double") for rows in ([("2021-06-30", 90.0), ("2021-09-30", 100.0), ("2021-12-31", 105.0)], [("2021-12-31", 210.0), ("2022-03-31", 220.0)]))
    got = {str(r.d): r.value for r in features.spliced(old, new, ["entity"], "d", "value", 0.1).collect()}
    assert got == {"2021-06-30": 180.0, "2021-09-30": 200.0, "2021-12-31": 210.0, "2022-03-31": 220.0}
    for bad in (new.withColumn("value", F.when(F.col("d") > "2022-01-01", 400.0).otherwise(F.col("value"))), new.filter("d < '2022-01-01'")):
        with pytest.raises(Exception, match="growth differs"):
            features.spliced(old, bad, ["entity"], "d", "value", 0.1).collect()


def test_unknown_series_and_lost_publications_are_errors(spark):
    rows = spark.createDataFrame([("a", D("2020-01-06"))], "series_id string, observation_date date")
    calendar = spark.createDataFrame([(D("2020-01-06"), D("2020-01-07"))], "d date, next_working_day date")
    rules = spark.createDataFrame([("b", "same_day")], "series_id string, rule string")
    with pytest.raises(Exception, match="no publication rule for series a"):
        calendars.published_by_rule(rows, rules, calendar).collect()
    twice = spark.createDataFrame([(D("2020-01-06"), D("2020-01-09")), (D("2020-01-06"), D("2020-01-08"))], "observation_date date, publication_date date")
    assert [str(r.publication_date) for r in calendars.attach_publication(rows, twice, None).collect()] == ["2020-01-08"]
    with pytest.raises(Exception, match="no publication for 2020-01-06"):
        calendars.attach_publication(rows, twice.limit(0), None).collect()
