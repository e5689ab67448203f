"""Plans that put several operators together."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tidegauge.operators import asof, evaluate, features, learners, lexicon, ranges
from tidegauge.operators import baselines as B
from tidegauge.plans.base import CALLS, LABELS, ORDERS, PANEL, W, calls, orders, query, table
from tidegauge.plans.ingestion import _LEX, _TOKENS, _lexicon, CATEGORIES
from tidegauge.plans.more import COLUMNS, FOLDS, KEYS, _member, _panel, _summary
from tidegauge.sources import ingest, sinks


@query("a3_series_files", "SELECT 'S' || n_regionkey AS series_id, last_day(CAST(o_orderdate AS DATE)) AS observation_date, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 5 > 0")
def _(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = o.select(F.concat(F.lit("S"), "n_regionkey").alias("s"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("DATE"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice").cast("string")).otherwise(".").alias("VALUE"))
    out = None
    for k in range(5):  # one file a region
        path = sinks.workspace(spark, "series")
        rows.filter(F.col("s") == f"S{k}").select("DATE", "VALUE").write.option("header", True).csv(path)
        own = ingest.read_series_files(spark, path, "DATE", "VALUE").withColumn("series_id", F.lit(f"S{k}"))
        out = own if out is None else out.unionByName(own)
    return out


@query("a14_run_artefacts", f"WITH {CALLS} SELECT 'r1' AS run_id, count(*) AS n FROM c UNION ALL SELECT 'r2', count(*) FROM c WHERE entity % 2 = 0")
def _(spark, d):
    path, rows = sinks.workspace(spark, "runs"), calls(spark, d).select("entity", "event_date", "y_true", "y_pred")
    for run_id, own in (("r1", rows), ("r2", rows.filter("entity % 2 = 0"))):
        sinks.write_run(own, own.groupBy("y_pred").agg(F.count(F.lit(1)).alias("n")), path, run_id)
    return spark.read.parquet(f"{path}/predictions").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("e16_gated_groups", f"WITH {ORDERS} SELECT entity, event_date, value, lag(value) OVER {W} AS value_lag_1, round(value - lag(value) OVER {W}, 3) AS value_diff_1 FROM o")
def _(spark, d):
    config = {"lags": {"horizons": (1,)}, "rolling": None, "changes": {"differences": (1,), "percents": ()}}
    return features.build(orders(spark, d), PANEL, ["value"], config).withColumn("value_diff_1", F.round("value_diff_1", 3))


@query("f19_ranked_features", """SELECT feature, round(pearson, 5) AS pearson FROM (SELECT 'l_quantity' AS feature, corr(l_quantity, l_extendedprice) AS pearson FROM lineitem UNION ALL SELECT 'l_discount', corr(l_discount, l_extendedprice) FROM lineitem
    UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM lineitem) ORDER BY abs(pearson) DESC NULLS LAST, feature LIMIT 2""")  # fmt: skip
def _(spark, d):
    rows = evaluate.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return evaluate.ranked(rows, ["pearson"], 2).select("feature", F.round("pearson", 5).alias("pearson"))


@query("h7_scores_on_spine", f"""WITH {_LEX}, {_TOKENS}, k AS (SELECT doc_id, count(*) FILTER (word IN (SELECT word FROM lx WHERE category = 'positive')) AS p, count(*) FILTER (word IN (SELECT word FROM lx WHERE category = 'negative')) AS n FROM tk GROUP BY 1),
    b AS (SELECT source AS series_id, DATE '1995-01-02' + CAST(doc_id % 1500 AS INTEGER) AS pub, CAST(sum(p) - sum(n) AS DOUBLE) / nullif(sum(p) + sum(n), 0) AS v FROM documents LEFT JOIN k USING (doc_id) GROUP BY 1, 2),
    s AS (SELECT * FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS event_date FROM orders), (SELECT DISTINCT source AS series_id FROM documents))
    SELECT s.series_id, event_date, v AS value, CAST(date_diff('day', pub, event_date) AS INTEGER) AS age_days, CAST(v IS NULL AS INTEGER) AS is_missing FROM s ASOF LEFT JOIN b ON s.series_id = b.series_id AND b.pub < s.event_date""")  # fmt: skip
def _(spark, d):
    docs = table(spark, d, "documents")
    counts = lexicon.category_counts(docs.withColumn("at", F.struct("source", "doc_id")), _lexicon(spark, d), CATEGORIES, id_col="at")
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("at.doc_id") % 1500).cast("int"))
    daily = counts.groupBy(F.col("at.source").alias("series_id"), day.alias("observation_date")).agg(*[F.sum(c).alias(c) for c in ("n_tokens", *CATEGORIES)])
    obs = lexicon.scores(daily, CATEGORIES).select("series_id", "observation_date", F.date_add("observation_date", 1).alias("publication_date"), F.col("tone").alias("value"))
    spine = orders(spark, d).select("event_date").distinct().crossJoin(ranges.broadcast_if_small(docs.select(F.col("source").alias("series_id")).distinct()))  # a row a series and day, as the result has
    return asof.as_of(spine, obs, ["series_id"])


@query("j6_benchmark_on_test", f"WITH {CALLS} SELECT year(event_date) AS year, count(*) AS n, count(y_market) AS n_covered, round(avg(CAST(y_true = y_market AS DOUBLE)), 6) AS accuracy FROM c WHERE event_date >= DATE '1998-01-01' GROUP BY 1")
def _(spark, d):
    test = calls(spark, d).filter("event_date >= '1998-01-01'")
    return evaluate.covered(test.withColumn("year", F.year("event_date")), "y_market", ["year"]).withColumn("accuracy", F.round("accuracy", 6))


@query("j11_holdout_walk_forward", f"""WITH {CALLS}, k AS (SELECT entity, event_date, y_true, lag(y_true) OVER {W} AS last_label FROM c)
    SELECT y_true, count(*) AS n, round(avg(CAST(y_true = last_label AS DOUBLE)), 6) AS accuracy FROM k WHERE event_date >= DATE '1999-01-01' AND last_label IS NOT NULL GROUP BY 1""")  # fmt: skip
def _(spark, d):
    rows = calls(spark, d).select("entity", "event_date", "y_true", B.persistence(PANEL, "y_true").alias("last_label")).filter("event_date >= '1999-01-01' and last_label is not null")
    return rows.groupBy("y_true").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("y_true") == F.col("last_label")).cast("double")), 6).alias("accuracy"))


@query("j12_aligned_probabilities", f"WITH {CALLS} SELECT entity, event_date, round(p, 6) AS cut, 0.0 AS hike, round(1 - p, 6) AS hold FROM c")
def _(spark, d):
    rows = calls(spark, d).select("entity", "event_date", F.array("p", 1 - F.col("p")).alias("proba"))
    wide = learners.aligned("proba", ["cut", "hold"], LABELS)
    return rows.select("entity", "event_date", wide.alias("w")).select("entity", "event_date", *[F.round(F.get("w", F.lit(i)), 6).alias(x) for i, x in enumerate(LABELS)])


@query("j11_holdout_refits")
def _(spark, d):
    rows = _panel(spark, d)
    folds = learners.holdout_folds(rows, "event_date", dt.date(1999, 1, 1), 12)
    return _summary(learners.walk_forward(rows, folds, "event_date", lambda: learners.model("logistic", COLUMNS, 3), KEYS), "fold")


@query("j17_soft_vote_of_given", f"""WITH {CALLS}, v AS (SELECT entity, event_date, [(0.3 * p + 0.5) / 2, 0.3 * (1 - p) / 2 + 0.1, (0.7 + 0.3) / 2] AS x FROM c)
    SELECT entity, event_date, round(x[1], 9) AS cut, round(x[2], 9) AS hike, CASE WHEN round(x[1], 9) >= round(x[2], 9) AND round(x[1], 9) >= round(x[3], 9) THEN 0.0 WHEN round(x[2], 9) >= round(x[3], 9) THEN 1.0 ELSE 2.0 END AS prediction FROM v""")  # fmt: skip
def _(spark, d):
    rows = calls(spark, d).select("entity", "event_date", F.lit(0.0).alias("label"), "p")
    first = rows.withColumn("proba", F.array(0.3 * F.col("p"), 0.3 * (1 - F.col("p")), F.lit(0.7)))
    second = rows.withColumn("proba", F.array(F.lit(0.5), F.lit(0.2), F.lit(0.3)))
    out = learners.soft_vote([first, second], KEYS, n_classes=len(LABELS))
    return out.select("entity", "event_date", *[F.round(F.get("proba", F.lit(i)), 9).alias(x) for i, x in enumerate(LABELS[:2])], "prediction")


@query("j19_selected_features")
def _(spark, d):
    def build(own):
        return learners.model("logistic", own, 3)

    return _summary(learners.walk_forward(_panel(spark, d), FOLDS, "event_date", build, KEYS, choose=lambda train: learners.selected(train, COLUMNS, "label", 2)), "fold")


@query("f23_leaderboard_by_recall", f"""WITH {CALLS}, m AS (SELECT 'persistence' AS model, y_true, y_pred AS y, y_market FROM c UNION ALL SELECT 'market', y_true, y_market, y_market FROM c WHERE y_market IS NOT NULL UNION ALL SELECT 'hold', y_true, 'hold', y_market FROM c),
    k AS (SELECT model, label, count(*) FILTER (y_true = label AND y = label) AS tp, count(*) FILTER (y_true = label AND y <> label) AS fn FROM m, (SELECT unnest(['cut', 'hike', 'hold']) AS label) GROUP BY 1, 2), z AS (SELECT model, avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END) AS b FROM k GROUP BY 1)
    SELECT model, round(b, 6) AS balanced_accuracy, round(avg(CAST(y_true = y AS DOUBLE)) FILTER (y_market IS NOT NULL) - avg(CAST(y_true = y_market AS DOUBLE)) FILTER (y_market IS NOT NULL), 6) AS lift, CAST(row_number() OVER (ORDER BY b DESC, model) AS INTEGER) AS place FROM m JOIN z USING (model) GROUP BY model, b""")  # fmt: skip
def _(spark, d):
    rows = calls(spark, d).withColumn("persisted", F.col("y_pred")).withColumn("hold", F.lit("hold"))
    found = evaluate.leaderboard(evaluate.suite(rows, {"persistence": "persisted", "market": "y_market", "hold": "hold"}, LABELS, "y_market"), ["balanced_accuracy"])
    return found.select("model", F.round("balanced_accuracy", 6).alias("balanced_accuracy"), F.round("lift", 6).alias("lift"), "place")


@query("j21_suite", f"""WITH {CALLS}, m AS (SELECT 'persistence' AS model, y_true, y_pred AS y, y_market FROM c UNION ALL SELECT 'market', y_true, y_market, y_market FROM c WHERE y_market IS NOT NULL),
    k AS (SELECT model, label, count(*) FILTER (y_true = label AND y = label) AS tp, count(*) FILTER (y_true <> label AND y = label) AS fp, count(*) FILTER (y_true = label AND y <> label) AS fn FROM m, (SELECT unnest(['cut', 'hike', 'hold']) AS label) GROUP BY 1, 2),
    z AS (SELECT model, round(avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END), 6) AS balanced_accuracy, round(sum(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 3, 6) AS macro_f1 FROM k GROUP BY 1)
    SELECT model, count(*) AS n, round(avg(CAST(y_true = y AS DOUBLE)), 6) AS accuracy, balanced_accuracy, macro_f1, round(avg(CAST(y_true = y AS DOUBLE)) FILTER (y_market IS NOT NULL) - avg(CAST(y_true = y_market AS DOUBLE)) FILTER (y_market IS NOT NULL), 6) AS lift FROM m JOIN z USING (model) GROUP BY 1, 4, 5""")  # fmt: skip
def _(spark, d):
    rows = evaluate.suite(calls(spark, d).withColumn("persisted", F.col("y_pred")), {"persistence": "persisted", "market": "y_market"}, LABELS, "y_market")
    return rows.select("model", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "lift")])


NEXT = "2030-01-15"


def _next_events(spark, d):
    """Each customer's next event: the previous level, the days since, and the latest published order total with its age, as of that day."""
    panel = orders(spark, d).select("entity", "event_date", "value")
    future = features.append_future(panel, PANEL, "event_date", "value", NEXT).filter(F.col("event_date") == NEXT)
    obs = panel.select("entity", F.lit("total").alias("series_id"), F.col("event_date").alias("observation_date"), F.date_add("event_date", 30).alias("publication_date"), "value")
    seen = asof.as_of(future.select("entity", "event_date"), obs, ["entity"]).withColumnsRenamed({"value": "published", "age_days": "published_age"}).drop("is_missing")
    return future.select("entity", "event_date", "previous_value", "gap_days").join(seen, ["entity", "event_date"])


@query("j22_next_event_features", f"""WITH {ORDERS}, n AS (SELECT entity, DATE '{NEXT}' AS event_date, arg_max(value, event_date) AS previous_value, DATE '{NEXT}' - max(event_date) AS gap FROM o GROUP BY 1), b AS (SELECT entity, event_date + 30 AS pub, value FROM o)
    SELECT n.entity, n.event_date, previous_value, CAST(gap AS INTEGER) AS gap_days, b.value AS published, CAST(n.event_date - pub AS INTEGER) AS published_age FROM n ASOF LEFT JOIN b ON n.entity = b.entity AND b.pub < n.event_date""")  # fmt: skip
def _(spark, d):
    return _next_events(spark, d)


@query("j22_next_event")
def _(spark, d):
    """Next events scored by a saved model that was fitted on all past rows, beside the benchmark and how stale the features are."""
    panel, path = _panel(spark, d), sinks.workspace(spark, "model")
    learners.model("logistic", COLUMNS, 3).fit(panel).write().save(path)
    chances = calls(spark, d).groupBy("entity").agg(F.max_by("p", "event_date").alias("p_lag_1"))
    lags = features.next_event_rows(orders(spark, d).select("entity", "event_date", "value"), PANEL, "event_date", "value", NEXT, lambda p: features.lags(p, ["value"], (1, 2))).select("entity", "value_lag_1", "value_lag_2")
    own = _next_events(spark, d).join(chances, "entity", "left").join(lags, "entity")
    rows = own.select("entity", "event_date", F.lit(0.0).alias("label"), "value_lag_1", "value_lag_2", "p_lag_1", F.col("gap_days").cast("double").alias("gap"), "gap_days", "published_age", F.col("value_lag_2").alias("second"), "previous_value")
    scored = learners.predicted(PipelineModel.load(path), rows, ["entity", "event_date"]).drop("label")
    market = B.implied_probabilities((F.col("previous_value") - F.col("second")) / 200000)
    kept = rows.select("entity", "event_date", "gap_days", "published_age", B.first_best(market).alias("benchmark"))
    return scored.join(kept, ["entity", "event_date"]).select("entity", "event_date", F.get(F.array(*map(F.lit, LABELS)), F.col("prediction").cast("int")).alias("choice"), "proba", "benchmark", "gap_days", "published_age")


@query("j23_saved_model")
def _(spark, d):
    rows, path = _panel(spark, d), sinks.workspace(spark, "model")
    candidates = {f"reg{r}": (lambda r=r: learners.model("logistic", COLUMNS, 3, regParam=r)) for r in (0.001, 0.1)}
    learners.save_best(learners.search(rows, FOLDS, "event_date", candidates, KEYS), candidates, rows, path)
    return _summary(learners.predicted(PipelineModel.load(path), rows, KEYS))


@query("j16_campaign")
def _(spark, d):
    """Each model tuned over both folds, its out-of-fold labels and those by tuned weights, as a suite."""
    members = {"logistic": learners.grid("logistic", COLUMNS, 3, {"regParam": [0.001, 0.1]}), "forest": learners.grid("forest", COLUMNS, 3, {"maxDepth": [3, 5], "numTrees": [5]})}
    rows = learners.campaign(_panel(spark, d), FOLDS, "event_date", members, KEYS, LABELS, [0.5, 1.0, 2.0])
    own = evaluate.classification(rows, LABELS, ["model", "candidate"])
    weighted = evaluate.classification(rows.withColumn("y_pred", F.col("weighted")), LABELS, ["model"]).select("model", F.col("balanced_accuracy").alias("weighted_balanced_accuracy"), F.col("macro_f1").alias("weighted_macro_f1"))
    return own.join(weighted, "model")
