"""Further plans: targets, set operations, sinks, learners."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidegauge.functions.scalars import rounded
from tidegauge.operators import baselines as B
from tidegauge.operators import calendars, evaluate, features, learners, neighbours, quality, targets
from tidegauge.plans.base import CALLS, LABELS, ORDERS, PANEL, W, calls, orders, query, table
from tidegauge.sources import ingest, sinks

DAY = "CAST(o_orderdate AS DATE)"


@query("b2_decisions", f"""WITH {ORDERS}, x AS (SELECT entity, event_date AS observation_date, round((value - lag(value) OVER {W}) / 100000, 2) AS c, round(value / 100000, 2) AS n FROM o)
    SELECT entity, observation_date, CAST(round_even(c * 100, 0) AS INTEGER) AS change_bps, n AS new_rate, round(n - c, 4) AS prior_rate FROM x WHERE observation_date >= DATE '1996-01-01' AND c IS NOT NULL AND entity % 11 <> 0""")  # fmt: skip
def _(spark, d):
    change = rounded((F.col("value") - F.lag("value").over(PANEL.window)) / 100000, 2)
    text = F.when(F.col("entity") % 11 == 0, "1.00 to 2.00").when(change > 0, F.concat(F.lit("+"), change.cast("string"))).otherwise(change.cast("string"))
    raw = orders(spark, d).select("entity", F.col("event_date").alias("observation_date"), text.alias("change_raw"), rounded(F.col("value") / 100000, 2).cast("string").alias("new_rate_raw"))
    return targets.decisions(raw, "1996-01-01").withColumn("prior_rate", F.round("prior_rate", 4))


@query("b7_identity_target", "SELECT o_orderkey, o_totalprice AS label FROM orders WHERE o_totalprice > 100000")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice").cast("string")).otherwise("n/a").alias("raw"))
    return targets.target(rows, "identity", "raw").select("o_orderkey", "label")


@query("b8_target_dispatch", f"""WITH {ORDERS}, x AS (SELECT *, value - lag(value) OVER {W} AS c FROM o) SELECT entity, event_date, CASE WHEN c < 0 THEN -1 WHEN c > 0 THEN 1 ELSE 0 END AS label FROM x WHERE c IS NOT NULL""")
def _(spark, d):
    rows = orders(spark, d).withColumn("c", F.col("value") - F.lag("value").over(PANEL.window))
    return targets.target(rows, "sign_of_change", "c", labels={"cut": -1, "hold": 0, "hike": 1}).select("entity", "event_date", "label")


@query("b10_missing_flags", "SELECT o_orderkey, CAST(o_totalprice < 50000 AS INTEGER) AS price_is_missing FROM orders")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("price"), F.lit(1).alias("price_age_days"))
    return rows.select("o_orderkey", *features.missing_flags(rows))


@query("b11_feature_columns", """SELECT l_returnflag, round(avg(l_quantity), 4) AS l_quantity, round(avg(l_discount), 4) AS l_discount, round(avg(l_tax), 4) AS l_tax FROM lineitem GROUP BY 1""")
def _(spark, d):
    rows = table(spark, d, "lineitem")
    own = targets.feature_columns(rows, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], ["l_extendedprice"])
    return rows.groupBy("l_returnflag").agg(*[F.round(F.avg(c), 4).alias(c) for c in own])


@query("c11_calendar_spine", f"""WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS lo, date_trunc('month', max(o_orderdate)) AS hi FROM orders), m AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS m FROM b)
    SELECT m AS month, count(o_orderkey) AS n_orders FROM m LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY 1""")  # fmt: skip
def _(spark, d):
    month = table(spark, d, "orders").select("o_orderkey", F.trunc(F.to_date("o_orderdate"), "MM").alias("m"))
    spine = month.agg(F.min("m").alias("lo"), F.max("m").alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    return spine.join(month, F.col("m") == F.col("month"), "left").groupBy("month").agg(F.count("o_orderkey").alias("n_orders"))


@query("d4_percent_year_on_year", f"WITH {ORDERS} SELECT a.entity, a.event_date, round(100 * (a.value - b.value) / nullif(b.value, 0), 4) AS yoy FROM o a ASOF LEFT JOIN o b ON a.entity = b.entity AND b.event_date <= a.event_date - 365")
def _(spark, d):
    return orders(spark, d).select("entity", "event_date", F.round(100 * features.year_on_year(PANEL, "value", "event_date"), 4).alias("yoy"))


@query("d6_feature_groups", f"WITH {ORDERS} SELECT entity, event_date, value, lag(value) OVER {W} AS value_lag_1, round(value - lag(value) OVER {W}, 3) AS value_diff_1 FROM o")
def _(spark, d):
    lag = F.lag("value").over(PANEL.window)
    return targets.without_collisions(orders(spark, d), [lag, F.round(F.col("value") - lag, 3)], ["value_lag_1", "value_diff_1"])


@query("d13_targets_in_window", f"SELECT o_orderkey, {DAY} AS day FROM orders WHERE {DAY} BETWEEN (SELECT CAST(min(l_shipdate) AS DATE) + 30 FROM lineitem) AND (SELECT CAST(max(l_shipdate) AS DATE) - 200 FROM lineitem)")
def _(spark, d):
    ship = F.to_date("l_shipdate")
    window = table(spark, d, "lineitem").agg(F.date_add(F.min(ship), 30).alias("since"), F.date_sub(F.max(ship), 200).alias("until"))
    return ingest.in_window(table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "day", window)


@query("b12_eligible_columns", f"WITH {ORDERS} SELECT entity, event_date, lag(value) OVER {W} AS value_lag_1 FROM o")
def _(spark, d):
    rows = orders(spark, d)
    return rows.select("entity", "event_date", *features.lags(PANEL, features.eligible(rows, ["value", "event_date", "absent"]), (1,)))


@query("e2_target_lags", f"WITH {CALLS} SELECT entity, event_date, {', '.join(f'lag(y_true, {h}) OVER {W} AS y_true_lag_{h}' for h in (1, 2, 3))} FROM c")
def _(spark, d):
    return calls(spark, d).select("entity", "event_date", *features.lags(PANEL, ["y_true"], (1, 2, 3)))


@query("f15_slices_by_phase", f"""WITH {CALLS}, x AS (SELECT *, value - lag(value, 3) OVER {W} AS dv FROM c)
    SELECT CASE WHEN dv > 10000 THEN 'tightening' WHEN dv < -10000 THEN 'easing' ELSE 'on-hold' END AS phase, count(*) AS n, round(avg(CAST(y_true = y_pred AS DOUBLE)), 6) AS accuracy FROM x GROUP BY 1""")  # fmt: skip
def _(spark, d):
    rows = calls(spark, d).withColumn("phase", features.cycle_phase(PANEL, "value", threshold=10000.0))
    return rows.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")), 6).alias("accuracy"))


@query("f16_error_table", f"""WITH {CALLS} SELECT entity, event_date, y_true, y_pred, array_to_string(list_filter([CASE WHEN event_date < DATE '1996-01-01' THEN 'early' END, CASE WHEN value > 200000 THEN 'large' END], lambda x: x IS NOT NULL), ', ') AS flags FROM c WHERE y_true <> y_pred""")
def _(spark, d):
    return evaluate.error_table(calls(spark, d), ["entity", "event_date"], {"early": F.col("event_date") < "1996-01-01", "large": F.col("value") > 200000})


@query("g3_union_of_frames", "SELECT 'customer' AS source, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def _(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return quality.union_of({"customer": c, "supplier": s}).groupBy("source", "k").agg(F.count(F.lit(1)).alias("n"))


@query("g4_set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    return quality.only_in_first(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")))


@query("g5_dedup_on_key", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) = 1")
def _(spark, d):
    rows = quality.newest(table(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


@query("a8_latest_snapshot", "SELECT c_mktsegment AS source, max(c_custkey % 97) AS snapshot, count(*) FILTER (c_custkey % 97 = m) AS n_rows FROM customer JOIN (SELECT c_mktsegment, max(c_custkey % 97) AS m FROM customer GROUP BY 1) USING (c_mktsegment) GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("source"), (F.col("c_custkey") % 97).alias("snapshot"))
    return quality.latest_snapshot(rows, ["source"], "snapshot").groupBy("source", "snapshot").agg(F.count(F.lit(1)).alias("n_rows"))


@query("a17_release_date", f"""SELECT o_orderkey, {DAY} AS released FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 2""")
def _(spark, d):
    day = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 3
    page = F.when(k == 0, F.concat(F.lit("<p>Released "), F.date_format(day, "d MMMM yyyy"), F.lit(" at noon</p>"))).when(k == 1, F.concat(F.lit("<time datetime='"), F.date_format(day, "yyyy-MM-dd"), F.lit("'>"))).otherwise(F.lit("<p>Soon</p>"))
    rows = table(spark, d, "orders").select("o_orderkey", page.alias("page"))
    rules = [(r"Released (\d{1,2} \w+ \d{4})", "d MMMM yyyy"), (r"datetime='(\d{4}-\d\d-\d\d)'", "yyyy-MM-dd")]
    return rows.select("o_orderkey", ingest.release_date(F.col("page"), rules).alias("released"))


@query("a11_parquet_sink", f"WITH {ORDERS} SELECT year(event_date) AS year, count(*) AS n, round(sum(value), 2) AS total FROM o GROUP BY 1")
def _(spark, d):
    rows = orders(spark, d).withColumn("year", F.year("event_date"))
    back = sinks.write_frame(rows, sinks.workspace(spark, "frame"), ["year"])
    return back.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("a13_prediction_log", f"WITH {CALLS} SELECT y_pred, count(*) AS n FROM c GROUP BY 1")
def _(spark, d):
    path, rows = sinks.workspace(spark, "log"), calls(spark, d).select("entity", "event_date", "y_pred")
    for part in (rows.filter("entity % 2 = 0"), rows.filter("entity % 2 = 1")):
        sinks.append_log(part, path)
    return spark.read.schema("entity long, event_date date, y_pred string").json(path).groupBy("y_pred").agg(F.count(F.lit(1)).alias("n"))


@query("j2_persistence", f"WITH {CALLS} SELECT entity, event_date, lag(y_true) OVER {W} AS persisted FROM c")
def _(spark, d):
    return calls(spark, d).select("entity", "event_date", B.persistence(PANEL, "y_true").alias("persisted"))


@query("j13_weighted_choice", f"""WITH {CALLS}, q AS (SELECT entity, event_date, p * 0.4 AS a, p * 0.6 * 0.5 AS b, (1 - p) * 0.8 AS h FROM c) SELECT entity, event_date, CASE WHEN a >= b AND a >= h THEN 'cut' WHEN b >= h THEN 'hike' ELSE 'hold' END AS choice FROM q""")
def _(spark, d):
    proba = {"cut": F.col("p") * 0.4, "hike": F.col("p") * 0.6, "hold": 1 - F.col("p")}
    return calls(spark, d).select("entity", "event_date", B.weighted_choice(proba, {"cut": 1.0, "hike": 0.5, "hold": 0.8}).alias("choice"))


def _panel(spark, d):
    """Rows with features and a label 0, 1, 2 (cut, hike, hold), known from the rows before."""
    rows = calls(spark, d)
    own = [*features.lags(PANEL, ["value"], (1, 2)), F.lag("p").over(PANEL.window).alias("p_lag_1"), F.date_diff("event_date", F.lag("event_date").over(PANEL.window)).cast("double").alias("gap")]
    label = sum((F.when(F.col("y_true") == x, float(i)).otherwise(0.0) for i, x in enumerate(LABELS)), F.lit(0.0))
    panel = rows.select("entity", "event_date", label.alias("label"), *own).filter("value_lag_1 is not null")
    return sinks.write_frame(panel, sinks.workspace(spark, "panel"))  # once, for all folds and candidates


COLUMNS = ["value_lag_1", "value_lag_2", "p_lag_1", "gap"]
FOLDS = [(dt.date(1998, 1, 1), dt.date(1999, 1, 1)), (dt.date(1999, 1, 1), dt.date(2003, 1, 1))]
KEYS = ["entity", "event_date"]


def _member(spark, d, kind, **params):
    return learners.walk_forward(_panel(spark, d), FOLDS, "event_date", lambda: learners.model(kind, COLUMNS, 3, **params), KEYS)


def _summary(df, *by):
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


@query("j9_logistic")
def _(spark, d):
    return _summary(_member(spark, d, "logistic"), "fold")


@query("j9_forest")
def _(spark, d):
    return _summary(_member(spark, d, "forest"), "fold")


@query("j9_lasso")
def _(spark, d):
    return _summary(_member(spark, d, "logistic", elasticNetParam=1.0), "fold")


@query("j9_boosted")
def _(spark, d):
    return _summary(_member(spark, d, "boosted", maxIter=3, maxDepth=2), "fold")


@query("j9_perceptron")
def _(spark, d):
    return _summary(_member(spark, d, "perceptron", maxIter=15), "fold")


@query("j15_search")
def _(spark, d):
    candidates = {f"reg{r}": (lambda r=r: learners.model("logistic", COLUMNS, 3, regParam=r)) for r in (0.001, 0.1)}
    return learners.search(_panel(spark, d), FOLDS, "event_date", candidates, KEYS)


@query("j17_soft_vote")
def _(spark, d):
    return _summary(learners.soft_vote([_member(spark, d, "logistic"), _member(spark, d, "forest", numTrees=5)], KEYS, n_classes=3))


@query("j18_stacking")
def _(spark, d):
    base = learners.stacked({k: _member(spark, d, k) for k in ("logistic", "forest")}, KEYS, 3)
    own = [f"{k}__{i}" for k in ("logistic", "forest") for i in range(3)]
    return _summary(learners.walk_forward(base, FOLDS[1:], "event_date", lambda: learners.model("logistic", own, 3), KEYS), "fold")


@query("j20_oversampled", """WITH k AS (SELECT CAST(label % 3 = 0 AS INTEGER) AS label, count(*) AS n FROM embeddings GROUP BY 1), t AS (SELECT *, max(n) OVER () AS top FROM k)
    SELECT label, 0 AS is_made, n FROM t UNION ALL SELECT label, 1, n * CAST(ceil((top - n) / n) AS BIGINT) FROM t WHERE n < top AND n > 1""")
def _(spark, d):
    rows = table(spark, d, "embeddings")
    width = rows.agg(F.max(F.size("embedding")).alias("w")).head()["w"] or 0
    x = [F.coalesce(F.get("embedding", F.lit(i)).cast("double"), F.lit(0.0)).alias(f"x{i}") for i in range(width)]
    rows = rows.select("vec_id", (F.col("label") % 3 == 0).cast("int").alias("label"), *x)
    return neighbours.oversampled(rows, [f"x{i}" for i in range(width)], "label", "vec_id").groupBy("label", "is_made").agg(F.count(F.lit(1)).alias("n"))


@query("c13_next_event", f"SELECT o_custkey AS entity, min({DAY}) AS next_day FROM orders WHERE {DAY} > DATE '1998-01-01' GROUP BY 1")
def _(spark, d):
    return calendars.next_after(orders(spark, d).select("entity", F.col("event_date").alias("d")), "1998-01-01", ["entity"])


@query("c6_working_day_before", f"SELECT o_orderkey, CAST({DAY} - CASE dayofweek({DAY}) WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS DATE) AS before FROM orders")
def _(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", calendars.working_day_before(day).alias("before"))
