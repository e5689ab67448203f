"""Plans over regimes and release rules given as tables, calendars' spines, change blocks, tables of models and selected features."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidegauge.functions import scalars as S
from tidegauge.operators import calendars as C
from tidegauge.operators import evaluate as E
from tidegauge.operators import features, learners, lexicon, targets
from tidegauge.plans.base import CALLS, LABELS, ORDERS, PANEL, W, calls, events, orders, query, table
from tidegauge.plans.dates import DAY, _days, _nth
from tidegauge.plans.ingestion import _LEX, CATEGORIES, _lexicon
from tidegauge.sources import ingest, sinks

D = dt.date


@query("b9_regime_windows", """SELECT o_orderkey, CAST(day < DATE '1995-03-01' AS INTEGER) AS regime_early, CAST(day BETWEEN DATE '1993-02-01' AND DATE '1994-06-30' AS INTEGER) AS regime_crisis, CAST(day >= DATE '1997-02-01' AS INTEGER) AS regime_new_cadence
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)""")  # fmt: skip
def _(spark, d):
    flags = S.regimes(F.to_date("o_orderdate"), {"early": (None, "1995-03-01")}, {"crisis": ("1993-02-01", "1994-06-30")}, {"new_cadence": "1997-02-01"})
    return table(spark, d, "orders").select("o_orderkey", *flags)


@query("b9_regimes_by_table", """SELECT o_orderkey, CAST(day < DATE '1993-05-01' OR day BETWEEN DATE '1996-01-10' AND DATE '1996-02-10' AS INTEGER) AS regime_low, CAST(day >= DATE '1995-06-01' AS INTEGER) AS regime_late FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)""")
def _(spark, d):
    rows = [("low", None, D(1993, 5, 1), False), ("low", D(1996, 1, 10), D(1996, 2, 10), True), ("late", D(1995, 6, 1), None, False), ("unused", None, None, True)]
    regimes = spark.createDataFrame(rows, "name string, since date, until date, closed boolean")
    return S.regimes_by_table(_days(spark, d), "d", regimes, ["low", "late"]).drop("d")


_AFTER = f"CAST(date_trunc('month', {DAY}) + INTERVAL 1 MONTH AS DATE)"
_LAST = f"CAST(last_day({DAY}) - CAST((dayofweek(last_day({DAY})) - 3 + 7) % 7 AS INTEGER) AS DATE)"


@query("c8_rule_table", f"""SELECT o_orderkey, series_id, CASE series_id WHEN 'odd' THEN CASE WHEN month({DAY}) = 12 THEN {_nth(_AFTER, 4, 4)} WHEN {DAY} < DATE '1995-01-01' THEN {_nth(_AFTER, 4, 2)} ELSE {_nth(_AFTER, 4, 3)} END ELSE {_LAST} END AS published
    FROM (SELECT *, CASE WHEN o_orderkey % 2 = 1 THEN 'odd' ELSE 'even' END AS series_id FROM orders)""")  # fmt: skip
def _(spark, d):
    rules = [("odd", 1, None, None, 12, 1, "THU", 4), ("odd", 2, None, D(1995, 1, 1), None, 1, "THU", 2), ("odd", 3, None, None, None, 1, "THU", 3), ("even", 1, None, None, None, 0, "WED", -1)]
    table_ = spark.createDataFrame(rules, "series_id string, priority int, since date, until date, month int, months_after int, weekday string, nth int")
    obs = _days(spark, d).select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 1, "odd").otherwise("even").alias("series_id"), F.col("d").alias("observation_date"))
    return C.published_by_rule_table(obs, table_).select("o_orderkey", "series_id", F.col("publication_date").alias("published"))


@query("c11_quarters", f"""WITH b AS (SELECT date_trunc('quarter', min(o_orderdate)) AS lo, date_trunc('quarter', max(o_orderdate)) AS hi FROM orders), m AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 3 MONTH)) AS DATE) AS d FROM b)
    SELECT d, count(o_orderkey) AS n_orders FROM m LEFT JOIN orders ON date_trunc('quarter', o_orderdate) = d GROUP BY 1""")  # fmt: skip
def _(spark, d):
    days = _days(spark, d)
    own = days.select("o_orderkey", F.trunc("d", "quarter").alias("d"))
    return C.spine(days, "d", "quarter").join(own, "d", "left").groupBy("d").agg(F.count("o_orderkey").alias("n_orders"))


@query("c11_weekdays", f"""WITH b AS (SELECT min({DAY}) AS lo, max({DAY}) AS hi FROM orders), m AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM b) SELECT d, count(o_orderkey) AS n_orders FROM m LEFT JOIN orders ON {DAY} = d WHERE dayofweek(d) BETWEEN 1 AND 5 GROUP BY 1""")
def _(spark, d):
    days = _days(spark, d)
    return C.spine(days, "d", "weekday").join(days, "d", "left").groupBy("d").agg(F.count("o_orderkey").alias("n_orders"))


@query("c13_schedule_moved", f"""WITH x AS (SELECT DISTINCT CASE WHEN day({DAY}) = 1 THEN {DAY} + 2 ELSE {DAY} END AS d FROM orders) SELECT d, 1 AS is_past FROM x WHERE d <= DATE '1997-10-01' UNION ALL SELECT * FROM (SELECT d, 0 FROM x WHERE d > DATE '1997-10-01' ORDER BY d LIMIT 8)""")
def _(spark, d):
    days = _days(spark, d)
    overrides = days.select("d").distinct().filter("day(d) = 1").withColumn("moved_to", F.date_add("d", 2))
    return C.schedule(days, "1997-10-01", 8, overrides)


@query("c13_next_after", f"SELECT min({DAY}) AS next_day FROM orders WHERE {DAY} > DATE '1996-02-29'")
def _(spark, d):
    return C.next_after(_days(spark, d), "1996-02-29")


@query("e9_change_blocks", f"""WITH {ORDERS} SELECT a.entity, a.event_date, round(a.dv, 3) AS value_diff_1, round(a.pv, 5) AS value_pct_1, round((a.value - b.value) / nullif(b.value, 0), 5) AS value_yoy_pct
    FROM (SELECT *, value - lag(value) OVER {W} AS dv, (value - lag(value) OVER {W}) / nullif(lag(value) OVER {W}, 0) AS pv FROM o) a ASOF LEFT JOIN o b ON a.entity = b.entity AND b.event_date <= a.event_date - 365""")  # fmt: skip
def _(spark, d):
    config = {"changes": {"differences": (1,), "percents": (1,)}, "year_on_year": {"day": "event_date"}}
    wide = features.build(orders(spark, d).select("entity", "event_date", "value"), PANEL, ["value"], config).drop("value")
    return wide.select("entity", "event_date", *[F.round(c, 3 if "diff" in c else 5).alias(c) for c in wide.columns[2:]])


_BOARD = f"""{CALLS}, m AS (SELECT 'persistence' AS model, y_true, y_pred AS y, y_market FROM c UNION ALL SELECT 'market', y_true, y_market, y_market FROM c WHERE y_market IS NOT NULL UNION ALL SELECT 'chance', y_true, CASE WHEN p * 0.4 >= p * 0.6 AND p * 0.4 >= 1 - p THEN 'cut' WHEN p * 0.6 >= 1 - p THEN 'hike' ELSE 'hold' END, y_market FROM c),
    k AS (SELECT model, label, count(*) FILTER (y_true = label AND y = label) AS tp, count(*) FILTER (y_true <> label AND y = label) AS fp, count(*) FILTER (y_true = label AND y <> label) AS fn FROM m, (SELECT unnest(['cut', 'hike', 'hold']) AS label) GROUP BY 1, 2), z AS (SELECT model, avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END) AS b FROM k GROUP BY 1),
    g AS (SELECT label, CASE label WHEN 'cut' THEN p * 0.4 WHEN 'hike' THEN p * 0.6 ELSE 1 - p END AS q, CAST(y_true = label AS DOUBLE) AS h FROM c, (SELECT unnest(['cut', 'hike', 'hold']) AS label)), e AS (SELECT i AS bin, CAST(i AS DOUBLE) / 10 AS low, CASE WHEN i = 9 THEN 1.0 ELSE CAST(i + 1 AS DOUBLE) / 10 END AS high FROM range(10) t(i)),
    r AS (SELECT label, bin, count(*) AS n, avg(q) AS mq, avg(h) AS mh FROM g JOIN e ON q >= low AND (q < high OR high = 1.0) GROUP BY 1, 2), ec AS (SELECT avg(v) AS ece FROM (SELECT label, sum(n * abs(mq - mh)) / sum(n) AS v FROM r GROUP BY 1)),
    t AS (SELECT model, b, count(*) AS n, avg(CAST(y_true = y AS DOUBLE)) FILTER (y_market IS NOT NULL) - avg(CAST(y_true = y_market AS DOUBLE)) FILTER (y_market IS NOT NULL) AS lift, CAST(row_number() OVER (ORDER BY b DESC, model) AS INTEGER) AS place FROM m JOIN z USING (model) GROUP BY 1, 2)"""


@query("f23_model_table", f"""WITH {_BOARD} SELECT model, n, round(b, 6) AS balanced_accuracy, CASE WHEN model = 'chance' THEN (SELECT round(ece, 6) FROM ec) END AS ece, round(lift, 6) AS lift, place, CAST(place = (SELECT min(place) FROM t WHERE model <> 'market') AND model <> 'market' AS INTEGER) AS is_best_learned FROM t""")
def _(spark, d):
    chance = {"cut": "p * 0.4", "hike": "p * 0.6", "hold": "1 - p"}
    rows = calls(spark, d).withColumns({"persisted": F.col("y_pred"), **{f"p_{k}": F.expr(v) for k, v in chance.items()}})
    best = F.when(F.expr(f"{chance['cut']} >= {chance['hike']} and {chance['cut']} >= {chance['hold']}"), "cut").when(F.expr(f"{chance['hike']} >= {chance['hold']}"), "hike").otherwise("hold")
    found = learners.model_table(rows.withColumn("chosen", best), {"persistence": "persisted", "market": "y_market", "chance": "chosen"}, LABELS, {"chance": {k: f"p_{k}" for k in LABELS}}, "y_market", ("market",))
    return found.select("model", "n", *[F.round(c, 6).alias(c) for c in ("balanced_accuracy", "ece", "lift")], "place", "is_best_learned")


_CHOICES = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def _f_sql(c: str) -> str:
    return f"SELECT '{c}' AS feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS score FROM (SELECT l_returnflag, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM x) AS g FROM x GROUP BY 1)"


@query("f26_selected_by_f", f"""WITH x AS (SELECT l_returnflag, {', '.join(f'coalesce(CASE WHEN l_linenumber < 6 THEN CAST({c} AS DOUBLE) END, (SELECT median(CAST({c} AS DOUBLE)) FROM lineitem WHERE l_linenumber < 6)) AS {c}' for c in _CHOICES)} FROM lineitem),
    s AS ({' UNION ALL '.join(map(_f_sql, _CHOICES))}) SELECT feature, round(score, 5) AS score FROM s ORDER BY s.score DESC LIMIT 2""")  # fmt: skip
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", *[F.when(F.col("l_linenumber") < 6, F.col(c).cast("double")).alias(c) for c in _CHOICES])
    own = learners.selected(rows, _CHOICES, "l_returnflag", 2, "f")
    return learners.selection_scores(rows, _CHOICES, "l_returnflag", "f").filter(F.col("feature").isin(own)).select("feature", F.round("score", 5).alias("score"))


@query("h6_scores_of_sources", f"""WITH {_LEX}, t AS (SELECT 'documents' AS source, doc_id AS id, n_chars AS stamp, text AS body FROM documents UNION ALL SELECT 'chats', conv_id, CAST(turn AS BIGINT), text FROM conversations), k AS (SELECT source, id, stamp, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(body, '')), '[a-z]+') AS w FROM t),
    p AS (SELECT list(word) AS pos FROM lx WHERE category = 'positive'), n AS (SELECT list(word) AS neg FROM lx WHERE category = 'negative') SELECT source, id, stamp, len(w) AS n_tokens, len(list_filter(w, lambda v: list_contains(pos, v))) AS positive, len(list_filter(w, lambda v: list_contains(neg, v))) AS negative FROM k, p, n""")  # fmt: skip
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("n_chars").cast("long").alias("stamp"))
    chats = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("text").alias("body"), F.col("turn").cast("long").alias("stamp"))
    found = lexicon.scores_of_sources({"documents": docs, "chats": chats, "pages": table(spark, d, "pages").limit(0)}, _lexicon(spark, d), CATEGORIES, "id", "body", "stamp")
    return found.select("source", "id", "stamp", "n_tokens", "positive", "negative")


@query("f1_weighted_shares", f"""WITH {CALLS}, x AS (SELECT y_true, year(event_date) AS year, 1 + day(event_date) % 3 AS w FROM c), s AS (SELECT year, y_true, count(*) AS n, sum(w) AS sw FROM x GROUP BY 1, 2)
    SELECT year, y_true, n, round(sw / sum(sw) OVER (PARTITION BY year), 6) AS share, CAST(row_number() OVER (PARTITION BY year ORDER BY sw DESC, y_true) = 1 AS INTEGER) AS is_majority FROM s""")  # fmt: skip
def _(spark, d):
    rows = calls(spark, d).select("y_true", F.year("event_date").alias("year"), (1 + F.day("event_date") % 3).alias("w"))
    return E.class_shares(rows, "y_true", "w", ["year"]).withColumn("share", F.round("share", 6))


@query("j10_run_report", f"""WITH {CALLS}, x AS (SELECT *, year(event_date) AS fold FROM c), k AS (SELECT fold, label, count(*) FILTER (y_true = label AND y_pred = label) AS tp, count(*) FILTER (y_true <> label AND y_pred = label) AS fp, count(*) FILTER (y_true = label AND y_pred <> label) AS fn
    FROM x, (SELECT unnest(['cut', 'hike', 'hold']) AS label) GROUP BY GROUPING SETS ((fold, label), (label))), m AS (SELECT fold, avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END) AS b FROM k GROUP BY 1), z AS (SELECT fold, CAST(grouping(fold) AS INTEGER) AS is_overall, count(*) AS n, avg(CAST(y_true = y_pred AS DOUBLE)) AS a,
    count(y_market) AS n_paired, avg(CAST(y_true = y_market AS DOUBLE)) AS h, avg(CAST(y_true = y_pred AS DOUBLE)) FILTER (y_market IS NOT NULL) AS g FROM x GROUP BY GROUPING SETS ((fold), ()))
    SELECT 'persistence-1' AS run_id, z.fold, is_overall, n, round(a, 6) AS accuracy, round(b, 6) AS balanced_accuracy, n_paired, round(h, 6) AS market_hit_rate, round(g - h, 6) AS lift FROM z JOIN m ON z.fold IS NOT DISTINCT FROM m.fold""")  # fmt: skip
def _(spark, d):
    found = E.run_report(calls(spark, d).withColumn("fold", F.year("event_date")), LABELS, "persistence-1", market="y_market")
    return found.select("run_id", "fold", "is_overall", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy")], "n_paired", *[F.round(c, 6).alias(c) for c in ("market_hit_rate", "lift")])


@query("b2_checked_decisions", f"""WITH {ORDERS}, x AS (SELECT entity, event_date AS observation_date, round((value - lag(value) OVER {W}) / 100000, 2) AS c, round(value / 100000, 2) AS n FROM o)
    SELECT entity, observation_date, observation_date - 1 AS publication_date, CAST(round_even(c * 100, 0) AS INTEGER) AS change_bps, n AS new_rate, round(n - c, 4) AS prior_rate FROM x WHERE observation_date >= DATE '1996-01-01' AND c IS NOT NULL""")  # fmt: skip
def _(spark, d):
    change = S.rounded((F.col("value") - F.lag("value").over(PANEL.window)) / 100000, 2)
    raw = orders(spark, d).select("entity", F.col("event_date").alias("observation_date"), F.date_sub("event_date", 1).alias("publication_date"), change.cast("string").alias("change_raw"), S.rounded(F.col("value") / 100000, 2).cast("string").alias("new_rate_raw"))
    return targets.decisions(raw, "1996-01-01").withColumn("prior_rate", F.round("prior_rate", 4))


@query("a16_speaker_role", """SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN c_mktsegment ELSE c_name END AS speaker, CASE c_custkey % 4 WHEN 0 THEN 'Governor' WHEN 1 THEN 'Assistant Governor (Economic)' WHEN 2 THEN 'Head of ' || c_mktsegment END AS role FROM customer""")
def _(spark, d):
    k = F.col("c_custkey") % 4
    line = F.when(k == 0, F.concat("c_name", F.lit(" AO [ * ]  Governor"))).when(k == 1, F.concat("c_name", F.lit("* Assistant Governor (Economic)"))).when(k == 2, F.concat("c_name", F.lit(" AC OAM Head of "), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    own = ingest.speaker_and_role(line)
    return table(spark, d, "customer").select("c_custkey", own["speaker"].alias("speaker"), own["role"].alias("role"))


@query("a11_bucketed_sink", f"WITH {ORDERS} SELECT year(event_date) AS year, count(*) AS n, count(DISTINCT entity) AS n_entities, round(sum(value), 2) AS total FROM o GROUP BY 1")
def _(spark, d):
    rows = orders(spark, d).withColumn("year", F.year("event_date"))
    back = sinks.write_bucketed(rows, sinks.workspace(spark, "buckets"), ["entity"], 8, ["year"])
    return back.groupBy("year", "bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("e"), F.sum("value").alias("t")).groupBy("year").agg(F.sum("n").alias("n"), F.sum("e").alias("n_entities"), F.round(F.sum("t"), 2).alias("total"))


@query("f24_persistence_overall", f"WITH {CALLS} SELECT y_pred AS previous, CAST(grouping(y_pred) AS INTEGER) AS is_overall, count(*) AS n, round(avg(CAST(y_true = y_pred AS DOUBLE)), 6) AS accuracy FROM c GROUP BY GROUPING SETS ((y_pred), ())")
def _(spark, d):
    return E.by_previous(calls(spark, d), "y_pred").select("previous", "is_overall", "n", F.round("accuracy", 6).alias("accuracy"))
