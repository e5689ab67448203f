"""Plans over predictions: metrics, calibration, slices, baselines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.operators import baselines as B
from tidegauge.operators import evaluate as E
from tidegauge.operators import quality
from tidegauge.operators.tiles import fold_statistics
from tidegauge.plans.base import CALLS, LABELS, ORDERS, PANEL, W, calls, orders, query, table

EDGES = [i / 10 for i in range(10)] + [1.0]
_HIT = "CAST(y_true = 'hold' AS DOUBLE)"


@query("f1_class_shares", f"WITH {CALLS} SELECT y_true, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM c GROUP BY 1")
def _(spark, d):
    return E.class_shares(calls(spark, d), "y_true").select("y_true", "n", F.round("share", 6).alias("share"))


@query("f2_confusion", f"WITH {CALLS} SELECT y_true, {', '.join(f'''count(*) FILTER (y_pred = '{x}') AS {x}''' for x in LABELS)} FROM c GROUP BY 1")
def _(spark, d):
    return E.confusion(calls(spark, d), LABELS)


_CLASSES = f"""{CALLS}, yr AS (SELECT *, year(event_date) AS year FROM c),
    k AS (SELECT year, label, count(*) FILTER (y_true = label AND y_pred = label) AS tp, count(*) FILTER (y_true <> label AND y_pred = label) AS fp, count(*) FILTER (y_true = label AND y_pred <> label) AS fn
          FROM yr, (SELECT unnest(['cut', 'hike', 'hold']) AS label) GROUP BY 1, 2),
    m AS (SELECT year, avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END) AS b, sum(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 3 AS f FROM k GROUP BY 1)"""


@query("f9_classification_by_year", f"""WITH {_CLASSES} SELECT year, n, round(a, 6) AS accuracy, round(b, 6) AS balanced_accuracy, round(f, 6) AS macro_f1
    FROM m JOIN (SELECT year, count(*) AS n, avg(CAST(y_true = y_pred AS DOUBLE)) AS a FROM yr GROUP BY 1) USING (year)""")  # fmt: skip
def _(spark, d):
    rows = E.classification(calls(spark, d).withColumn("year", F.year("event_date")), LABELS, ["year"])
    return rows.select("year", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1")])


@query("f6_f7_probability_scores", f"""WITH {CALLS}, q AS (SELECT y_true, p * 0.4 AS pc, p * 0.6 AS ph, 1 - p AS po FROM c)
    SELECT round(avg(-ln(greatest(least(CASE y_true WHEN 'cut' THEN pc WHEN 'hike' THEN ph ELSE po END, 1 - 2.220446049250313e-16), 2.220446049250313e-16))), 5) AS log_loss,
           round(avg(pow(pc - CAST(y_true = 'cut' AS DOUBLE), 2) + pow(ph - CAST(y_true = 'hike' AS DOUBLE), 2) + pow(po - CAST(y_true = 'hold' AS DOUBLE), 2)), 6) AS brier FROM q""")  # fmt: skip
def _(spark, d):
    proba = {"cut": F.col("p") * 0.4, "hike": F.col("p") * 0.6, "hold": 1 - F.col("p")}
    own = F.when(F.col("y_true") == "cut", proba["cut"]).when(F.col("y_true") == "hike", proba["hike"]).otherwise(proba["hold"])
    return calls(spark, d).agg(F.round(E.log_loss(own), 5).alias("log_loss"), F.round(E.brier(proba), 6).alias("brier"))


@query("f8_regression", """WITH x AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * p_retailprice AS q FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_returnflag, round(sqrt(avg((y - q) * (y - q))), 3) AS rmse, round(avg(abs(y - q)), 3) AS mae, round(1 - sum((y - q) * (y - q)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(CAST(sign(y) = sign(q) AS DOUBLE)), 6) AS directional_accuracy FROM x GROUP BY 1""")  # fmt: skip
def _(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_returnflag", F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * F.col("p_retailprice")).alias("y_pred"))
    return E.regression(rows, ["l_returnflag"]).select("l_returnflag", F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), F.round("r2", 6).alias("r2"), F.round("directional_accuracy", 6).alias("directional_accuracy"))


_SHARES = {"hit_rate": "y_true = y_pred", "market_hit_rate": "y_true = y_market", "both": "y_true = y_pred AND y_true = y_market", "only_model": "y_true = y_pred AND y_true <> y_market", "only_market": "y_true <> y_pred AND y_true = y_market", "neither": "y_true <> y_pred AND y_true <> y_market"}


@query("f10_paired_hit_rate", f"""WITH {CALLS} SELECT year(event_date) AS year, count(*) AS n, {', '.join(f'round(avg(CAST({v} AS DOUBLE)), 6) AS {k}' for k, v in _SHARES.items())},
    round(avg(CAST(y_true = y_pred AS DOUBLE)) - avg(CAST(y_true = y_market AS DOUBLE)), 6) AS lift FROM c WHERE y_market IS NOT NULL GROUP BY 1""")  # fmt: skip
def _(spark, d):
    rows = E.paired(calls(spark, d).withColumn("year", F.year("event_date")), ["year"])
    return rows.select("year", "n", *[F.round(c, 6).alias(c) for c in (*_SHARES, "lift")])


_BINS = f"""{CALLS}, e AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin, unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS low, unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS high),
    r AS (SELECT bin, low, high, count(p) AS n, avg(p) AS m, avg({_HIT}) FILTER (p IS NOT NULL) AS h FROM e LEFT JOIN c ON p >= low AND (p < high OR high = 1.0) GROUP BY 1, 2, 3)"""


@query("f11_reliability", f"WITH {_BINS} SELECT bin, low, high, n, round(m, 6) AS mean_pred, round(h, 6) AS observed FROM r")
def _(spark, d):
    rows = calls(spark, d).withColumn("hit", (F.col("y_true") == "hold").cast("int"))
    return E.reliability(rows, "p", "hit", EDGES).withColumn("mean_pred", F.round("mean_pred", 6)).withColumn("observed", F.round("observed", 6))


@query("f12_calibration_errors", f"WITH {_BINS} SELECT round(sum(n * abs(m - h)) / sum(n), 6) AS ece, round(max(abs(m - h)), 6) AS mce FROM r WHERE n > 0")
def _(spark, d):
    rows = calls(spark, d).withColumn("hit", (F.col("y_true") == "hold").cast("int"))
    return E.calibration_errors(E.reliability(rows, "p", "hit", EDGES)).select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


@query("f13_recall_by_class", f"WITH {CALLS} SELECT y_true, count(*) AS support, count(*) FILTER (y_true = y_pred) AS correct, round(avg(CAST(y_true = y_pred AS DOUBLE)), 6) AS recall FROM c GROUP BY 1")
def _(spark, d):
    return E.recall_by_class(calls(spark, d)).withColumn("recall", F.round("recall", 6))


_FLAGS = {"early": "event_date < DATE '1996-01-01'", "large": "value > 200000", "always": "value > 0"}


@query("f14_slices_by_flag", " UNION ALL ".join(f"SELECT * FROM (WITH {CALLS} SELECT '{k}' AS flag, count(*) FILTER ({v}) AS n_on, round(avg(CAST(y_true = y_pred AS DOUBLE)) FILTER ({v}), 6) AS accuracy_on, count(*) FILTER (NOT ({v})) AS n_off, round(avg(CAST(y_true = y_pred AS DOUBLE)) FILTER (NOT ({v})), 6) AS accuracy_off FROM c) WHERE n_on > 0 AND n_off > 0" for k, v in _FLAGS.items()))
def _(spark, d):
    rows = calls(spark, d).select("*", *[F.expr(v).cast("int").alias(k) for k, v in _FLAGS.items()])
    return E.sliced(rows, list(_FLAGS)).withColumn("accuracy_on", F.round("accuracy_on", 6)).withColumn("accuracy_off", F.round("accuracy_off", 6))


_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("f17_correlations", " UNION ALL ".join(f"""SELECT '{c}' AS feature, count(*) AS n_obs, round(corr(x, y), 5) AS pearson, round(corr(rx, ry), 5) AS spearman FROM (SELECT CAST({c} AS DOUBLE) AS x, l_extendedprice AS y,
    rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS rx, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS ry FROM lineitem)""" for c in _FEATURES))  # fmt: skip
def _(spark, d):
    rows = E.associations(table(spark, d, "lineitem"), _FEATURES, "l_extendedprice")
    return rows.withColumn("pearson", F.round("pearson", 5)).withColumn("spearman", F.round("spearman", 5))


_DISCRETE = ["l_linenumber", "l_linestatus", "l_discount"]


@query("f18_mutual_information", " UNION ALL ".join(f"""SELECT '{c}' AS feature, round(sum(n / t * ln(n * t / (nx * ny))), 7) AS mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY {c}) AS nx, sum(n) OVER (PARTITION BY l_returnflag) AS ny
    FROM (SELECT {c}, l_returnflag, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2))""" for c in _DISCRETE))  # fmt: skip
def _(spark, d):
    return E.mutual_information(table(spark, d, "lineitem"), _DISCRETE, "l_returnflag").withColumn("mi", F.round("mi", 7))


@query("f26_anova_imputed", """WITH x AS (SELECT l_returnflag, coalesce(CASE WHEN l_discount > 0.02 THEN l_quantity END, (SELECT median(l_quantity) FROM lineitem WHERE l_discount > 0.02)) AS q FROM lineitem)
    SELECT 'q' AS feature, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 5) AS f FROM (SELECT l_returnflag, count(*) AS n, avg(q) AS m, var_pop(q) AS v, (SELECT avg(q) FROM x) AS g FROM x GROUP BY 1)""")  # fmt: skip
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_discount") > 0.02, F.col("l_quantity").cast("double")).alias("q"))
    return E.anova_f(E.imputed(rows, ["q"]), ["q"], "l_returnflag").withColumn("f", F.round("f", 5))


@query("f15_slices_by_surprise", f"""WITH {CALLS} SELECT CASE WHEN y_market = y_true THEN 'expected' ELSE 'surprise' END AS event, count(*) AS n, round(avg(CAST(y_true = y_pred AS DOUBLE)), 6) AS accuracy FROM c WHERE y_market IS NOT NULL GROUP BY 1""")
def _(spark, d):
    kind = F.when(F.col("y_market").isNull(), None).when(F.col("y_market") == F.col("y_true"), "expected").otherwise("surprise")
    return E.by_slice(calls(spark, d), "event", kind).withColumn("accuracy", F.round("accuracy", 6))


@query("f26_anova", " UNION ALL ".join(f"""SELECT '{c}' AS feature, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 5) AS f
    FROM (SELECT l_returnflag, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM lineitem) AS g FROM lineitem GROUP BY 1)""" for c in ("l_quantity", "l_extendedprice")))  # fmt: skip
def _(spark, d):
    return E.anova_f(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], "l_returnflag").withColumn("f", F.round("f", 5))


@query("f24_persistence_by_previous", f"WITH {CALLS} SELECT y_pred AS previous, count(*) AS n, round(avg(CAST(y_true = y_pred AS DOUBLE)), 6) AS accuracy FROM c GROUP BY 1")
def _(spark, d):
    return E.by_previous(calls(spark, d), "y_pred").filter("is_overall = 0").select("previous", "n", F.round("accuracy", 6).alias("accuracy"))


@query("f25_balanced_weights", "SELECT doc_id, toxic, round((SELECT count(*) FROM labels) / (2 * count(*) OVER (PARTITION BY toxic)), 6) AS weight FROM labels")
def _(spark, d):
    return B.balanced_weights(table(spark, d, "labels"), "toxic").select("doc_id", "toxic", F.round("weight", 6).alias("weight"))


@query("f23_leaderboard", f"""WITH {CALLS} SELECT model, round(accuracy, 4) AS accuracy, CAST(row_number() OVER (ORDER BY accuracy DESC, model) AS INTEGER) AS place
    FROM (SELECT 'persistence' AS model, avg(CAST(y_true = y_pred AS DOUBLE)) AS accuracy FROM c UNION ALL SELECT 'market', avg(CAST(y_true = y_market AS DOUBLE)) FROM c UNION ALL SELECT 'hold', avg(CAST(y_true = 'hold' AS DOUBLE)) FROM c)""")  # fmt: skip
def _(spark, d):
    models = F.array(*[F.struct(F.lit(n).alias("model"), c.alias("y")) for n, c in (("persistence", F.col("y_pred")), ("market", F.col("y_market")), ("hold", F.lit("hold")))])
    rows = calls(spark, d).select("y_true", F.explode(models).alias("m")).groupBy("m.model").agg(F.avg((F.col("y_true") == F.col("m.y")).cast("double")).alias("accuracy"))
    return rows.select("model", F.round("accuracy", 4).alias("accuracy"), F.row_number().over(Window.orderBy(F.desc("accuracy"), "model")).alias("place"))


@query("j1_majority", f"""WITH {CALLS}, k AS (SELECT entity, event_date, {', '.join(f"count(*) FILTER (y_true = '{x}') OVER b AS n_{x}" for x in LABELS)} FROM c WINDOW b AS (PARTITION BY entity ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT entity, event_date, CASE WHEN n_cut + n_hike + n_hold = 0 THEN NULL WHEN n_cut >= n_hike AND n_cut >= n_hold THEN 'cut' WHEN n_hike >= n_hold THEN 'hike' ELSE 'hold' END AS majority, round(n_hold / nullif(n_cut + n_hike + n_hold, 0), 6) AS share_hold FROM k""")  # fmt: skip
def _(spark, d):
    pick, shares = B.majority_so_far(PANEL, "y_true", LABELS)
    return calls(spark, d).select("entity", "event_date", pick.alias("majority"), F.round(shares["hold"], 6).alias("share_hold"))


@query("j3_expanding_line", f"""WITH {ORDERS}, x AS (SELECT entity, event_date, value, lag(value) OVER {W} AS before FROM o)
    SELECT entity, event_date, CASE WHEN regr_count(value, before) OVER b >= 3 THEN round(regr_slope(value, before) OVER b, 4) END AS slope FROM x
    WINDOW b AS (PARTITION BY entity ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")  # fmt: skip
def _(spark, d):
    rows = orders(spark, d).withColumn("before", F.lag("value").over(PANEL.window))
    return rows.select("entity", "event_date", F.round(B.expanding_line(PANEL, "before", "value")[0], 4).alias("slope"))


@query("j4_implied_probabilities", f"""WITH {ORDERS}, x AS (SELECT entity, event_date, (value - lag(value) OVER {W}) / 200000 AS dv FROM o), y AS (SELECT *, least(greatest(-dv / 0.25, 0), 1) AS cut, least(greatest(dv / 0.25, 0), 1) AS hike FROM x)
    SELECT entity, event_date, CASE WHEN dv IS NOT NULL THEN round(cut, 6) END AS cut, CASE WHEN dv IS NOT NULL THEN round(hike, 6) END AS hike, CASE WHEN dv IS NOT NULL THEN round(1 - cut - hike, 6) END AS hold, CASE WHEN dv IS NULL THEN NULL WHEN cut >= hike AND cut >= 1 - cut - hike THEN 'cut' WHEN hike >= 1 - cut - hike THEN 'hike' ELSE 'hold' END AS choice FROM y""")  # fmt: skip
def _(spark, d):
    rows = orders(spark, d).withColumn("dv", (F.col("value") - F.lag("value").over(PANEL.window)) / 200000)
    proba = {k: F.when(F.col("dv").isNotNull(), c) for k, c in B.implied_probabilities(F.col("dv")).items()}
    named = rows.select("entity", "event_date", *[c.alias(k) for k, c in proba.items()])
    return named.select("entity", "event_date", *[F.round(k, 6).alias(k) for k in LABELS], B.first_best({k: F.col(k) for k in LABELS}).alias("choice"))


@query("j5_contract_choice", """WITH x AS (SELECT o_orderkey, o_totalprice AS v, CAST(o_orderdate AS DATE) AS d, day(last_day(o_orderdate)) AS n FROM orders), y AS (SELECT *, (n - day(d)) / n AS share FROM x)
    SELECT o_orderkey, CAST(CASE WHEN share >= 0.5 THEN date_trunc('month', d) ELSE date_trunc('month', d) + INTERVAL 1 MONTH END AS DATE) AS contract, round(CASE WHEN share >= 0.5 THEN (v - (1 - share) * 100000) / share ELSE v END, 6) AS rate FROM y""")  # fmt: skip
def _(spark, d):
    month, left, own = B.contract_for(F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", month.alias("contract"), F.round(B.rate_after(F.col("o_totalprice"), F.lit(100000.0), left, own), 6).alias("rate"))


_FOLDS = f"""{ORDERS}, n AS (SELECT entity, count(*) AS n FROM o GROUP BY 1),
    f AS (SELECT entity, CAST(i AS INTEGER) AS fold, 5 + 2 * i AS test_lo FROM (SELECT entity, n, unnest(range(0, (n - 2 - 5) // 2 + 1)) AS i FROM n WHERE n >= 7))"""


@query("j8_folds", f"WITH {_FOLDS} SELECT entity, fold, CAST(0 AS BIGINT) AS train_lo, test_lo AS train_hi, test_lo, test_lo + 2 AS test_hi FROM f")
def _(spark, d):
    return B.folds(orders(spark, d), ["entity"], 5, 2, 2)


@query("d11_fold_members", f"""WITH {_FOLDS}, p AS (SELECT entity, value, row_number() OVER {W} - 1 AS pos FROM o)
    SELECT entity, fold, CAST(pos >= test_lo AS INTEGER) AS is_test, count(*) AS n, round(avg(value), 4) AS mean_value FROM p JOIN f USING (entity) WHERE pos < test_lo + 2 GROUP BY 1, 2, 3""")  # fmt: skip
def _(spark, d):
    o = orders(spark, d).select("entity", "event_date", "value")
    found = fold_statistics(o, PANEL, B.folds(o, ["entity"], 5, 2, 2), ["value"])
    return found.select("entity", "fold", "is_test", "n", F.round("value_mean", 4).alias("mean_value"))


_GRID = [0.5, 1.0, 2.0]


@query("j14_tuned_weights", f"""WITH {CALLS}, g AS (SELECT a AS w_hike, b AS w_hold FROM (SELECT unnest([0.5, 1.0, 2.0]) AS a), (SELECT unnest([0.5, 1.0, 2.0]) AS b)),
    q AS (SELECT y_true, w_hike, w_hold, p * 0.4 AS c1, p * 0.6 * w_hike AS c2, (1 - p) * w_hold AS c3 FROM c, g)
    SELECT 1.0 AS w_cut, w_hike, w_hold, round(avg(CAST(y_true = CASE WHEN c1 >= c2 AND c1 >= c3 THEN 'cut' WHEN c2 >= c3 THEN 'hike' ELSE 'hold' END AS DOUBLE)), 6) AS accuracy FROM q GROUP BY 2, 3""")  # fmt: skip
def _(spark, d):
    rows = calls(spark, d).select("y_true", (F.col("p") * 0.4).alias("pc"), (F.col("p") * 0.6).alias("ph"), (1 - F.col("p")).alias("po"))
    return B.tuned_weights(rows, {"cut": "pc", "hike": "ph", "hold": "po"}, _GRID).select("w_cut", "w_hike", "w_hold", F.round("accuracy", 6).alias("accuracy"))


@query("j14_tuned_scores", f"""WITH {CALLS}, g AS (SELECT a AS w_hike, b AS w_hold FROM (SELECT unnest([0.5, 1.0, 2.0]) AS a), (SELECT unnest([0.5, 1.0, 2.0]) AS b)),
    q AS (SELECT y_true, w_hike, w_hold, p * 0.4 AS c1, p * 0.6 * w_hike AS c2, (1 - p) * w_hold AS c3 FROM c, g), y AS (SELECT y_true, w_hike, w_hold, CASE WHEN c1 >= c2 AND c1 >= c3 THEN 'cut' WHEN c2 >= c3 THEN 'hike' ELSE 'hold' END AS y FROM q),
    k AS (SELECT w_hike, w_hold, label, count(*) FILTER (y_true = label AND y = label) AS tp, count(*) FILTER (y_true <> label AND y = label) AS fp, count(*) FILTER (y_true = label AND y <> label) AS fn FROM y, (SELECT unnest(['cut', 'hike', 'hold']) AS label) GROUP BY 1, 2, 3)
    SELECT 1.0 AS w_cut, w_hike, w_hold, round(avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END), 6) AS balanced_accuracy, round(sum(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 3, 6) AS macro_f1 FROM k GROUP BY 2, 3""")  # fmt: skip
def _(spark, d):
    rows = calls(spark, d).select("y_true", (F.col("p") * 0.4).alias("pc"), (F.col("p") * 0.6).alias("ph"), (1 - F.col("p")).alias("po"))
    found = B.tuned_weights(rows, {"cut": "pc", "hike": "ph", "hold": "po"}, _GRID)
    return found.select("w_cut", "w_hike", "w_hold", F.round("balanced_accuracy", 6).alias("balanced_accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query("f11_quantile_bins", f"""WITH {CALLS}, q AS (SELECT list_sort(list_distinct(list_concat([0.0, 1.0], quantile_cont(p, [0.2, 0.4, 0.6, 0.8])))) AS e FROM c), e AS (SELECT CAST(i AS INTEGER) AS bin, e[i + 1] AS low, e[i + 2] AS high FROM (SELECT e, unnest(range(len(e) - 1)) AS i FROM q))
    SELECT bin, count(p) AS n, round(avg(p), 6) AS mean_pred, round(avg(CAST(y_true = 'hold' AS DOUBLE)) FILTER (p IS NOT NULL), 6) AS observed FROM e LEFT JOIN c ON p >= low AND (p < high OR high = 1.0) GROUP BY 1""")  # fmt: skip
def _(spark, d):
    rows = calls(spark, d).withColumn("hit", (F.col("y_true") == "hold").cast("int"))
    return E.reliability(rows, "p", "hit", E.quantile_edges(rows, "p", 5)).select("bin", "n", F.round("mean_pred", 6).alias("mean_pred"), F.round("observed", 6).alias("observed"))


@query("g1_stable_sort", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def _(spark, d):
    return quality.in_order(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_shipdate"])


@query("j17_hard_vote", f"""WITH {CALLS}, v AS (SELECT entity, event_date, y_pred AS y, 2.0 AS w FROM c UNION ALL SELECT entity, event_date, y_market, 1.5 FROM c WHERE y_market IS NOT NULL UNION ALL SELECT entity, event_date, 'hold', 1.0 FROM c),
    t AS (SELECT entity, event_date, y, sum(w) AS votes FROM v GROUP BY 1, 2, 3)
    SELECT entity, event_date, y AS y_pred, CAST(votes AS DOUBLE) AS votes FROM t QUALIFY row_number() OVER (PARTITION BY entity, event_date ORDER BY votes DESC, y) = 1""")  # fmt: skip
def _(spark, d):
    c = calls(spark, d)
    votes = F.array(F.struct(F.col("y_pred").alias("y"), F.lit(2.0).alias("w")), F.struct(F.col("y_market").alias("y"), F.lit(1.5).alias("w")), F.struct(F.lit("hold").alias("y"), F.lit(1.0).alias("w")))
    rows = c.select("entity", "event_date", F.explode(votes).alias("v")).select("entity", "event_date", F.col("v.y").alias("y_pred"), F.col("v.w").alias("w")).filter("y_pred is not null")
    return B.voted(rows, ["entity", "event_date"], "w")


@query("j7_dev_test_split", "SELECT CAST(CAST(o_orderdate AS DATE) >= DATE '1997-06-01' AS INTEGER) AS is_test, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy(B.is_test(F.to_date("o_orderdate"), "1997-06-01").alias("is_test")).agg(F.count(F.lit(1)).alias("n"))


@query("b16_invariants", """SELECT rule, count(*) AS n_failed, min(l_orderkey || '|' || l_linenumber) AS first_key FROM (SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN NOT l_quantity <= 45 THEN 'small' END, CASE WHEN NOT l_discount < 0.1 THEN 'discount' END,
    CASE WHEN NOT l_linestatus = 'O' THEN 'open' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem) GROUP BY 1""")  # fmt: skip
def _(spark, d):
    rules = {"small": F.col("l_quantity") <= 45, "discount": F.col("l_discount") < 0.1, "open": F.col("l_linestatus") == "O"}
    return quality.failures(table(spark, d, "lineitem"), rules, ["l_orderkey", "l_linenumber"])


@query("d8_reconcile_customers", """SELECT k AS c_custkey, f AS finding FROM (SELECT c_custkey AS k, 'missing' AS f FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_mktsegment <> 'BUILDING'
    UNION ALL SELECT DISTINCT o_custkey, 'extra' FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT o_custkey, 'duplicate' FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) > 1)""")  # fmt: skip
def _(spark, d):
    customers = table(spark, d, "customer")
    customer = customers.select("c_custkey")
    actual = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return quality.reconciled(customer, actual, "c_custkey", customers.filter("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("d12_unmatched", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(spark, d):
    return quality.absent(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").filter("l_quantity > 45"), {"p_partkey": "l_partkey"})


@query("f21_staleness", """WITH x AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) FILTER (o_orderstatus = 'O') AS a, max(CAST(o_orderdate AS DATE)) FILTER (o_orderstatus = 'F') AS b, max(CAST(o_orderdate AS DATE)) FILTER (o_totalprice > 400000) AS c FROM orders GROUP BY 1),
    y AS (SELECT o_custkey, list_filter([DATE '2002-01-01' - a, DATE '2002-01-01' - b, DATE '2002-01-01' - c], lambda v: v IS NOT NULL) AS l FROM x)
    SELECT o_custkey, CAST(3 - len(l) AS INTEGER) AS n_missing, CAST(list_median(l) AS DOUBLE) AS median_age, CAST(list_max(l) AS INTEGER) AS max_age FROM y""")  # fmt: skip
def _(spark, d):
    day = F.to_date("o_orderdate")
    last = lambda cond: F.date_diff(F.lit("2002-01-01").cast("date"), F.max(F.when(cond, day)))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(last(F.col("o_orderstatus") == "O").alias("a"), last(F.col("o_orderstatus") == "F").alias("b"), last(F.col("o_totalprice") > 400000).alias("c"))
    return rows.select("o_custkey", *quality.staleness(rows, ["a", "b", "c"]))


@query("a12_manifest", f"WITH {ORDERS} SELECT count(*) AS n_rows, min(event_date) AS first_day, max(event_date) AS last_day FROM o")
def _(spark, d):
    return quality.manifest(orders(spark, d), "event_date").select("n_rows", "first_day", "last_day")


@query("a12_manifest_digest")
def _(spark, d):
    return quality.manifest(orders(spark, d), "event_date")


@query("a7_priority_dedup", """WITH x AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS day, o_totalprice AS v, 'page' AS source, 1 AS pr FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, CAST(o_orderdate AS DATE), o_totalprice, 'archive', 2 FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT o_custkey, CAST(l_shipdate AS DATE), l_extendedprice, 'inferred', 3 FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT k, day, v, source FROM x QUALIFY row_number() OVER (PARTITION BY k, day ORDER BY pr, v DESC) = 1""")  # fmt: skip
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("v"), "o_orderstatus", "o_orderkey")
    found = {"page": o.filter("o_orderstatus = 'F'"), "archive": o.filter("o_orderstatus = 'O'")}
    found["inferred"] = table(spark, d, "lineitem").join(o.select("k", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("k", F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("v"))
    return quality.by_priority({name: df.select("k", "day", "v") for name, df in found.items()}, ["k", "day"], [F.desc("v")])


@query("a6_splice_newest", """WITH x AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v, 1 AS pr, o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_custkey, CAST(o_orderdate AS DATE), o_totalprice + 1, 2, o_orderkey FROM orders WHERE o_orderstatus <> 'F')
    SELECT o_custkey, d, v FROM x QUALIFY row_number() OVER (PARTITION BY o_custkey, d ORDER BY pr DESC, k DESC) = 1""")  # fmt: skip
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("k"), "o_orderstatus")
    both = o.filter("o_orderstatus <> 'P'").withColumn("pr", F.lit(1)).unionByName(o.filter("o_orderstatus <> 'F'").withColumn("v", F.col("v") + 1).withColumn("pr", F.lit(2)))
    return quality.newest(both, ["o_custkey", "d"], [F.desc("pr"), F.desc("k")]).select("o_custkey", "d", "v")


@query("f20_inventory", """SELECT n_name AS source, CAST(s_suppkey AS VARCHAR) AS series_id, count(l_orderkey) AS n_observations, max(CAST(l_shipdate AS DATE)) AS last_observation
    FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    registry = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("source"), F.col("s_suppkey").cast("string").alias("series_id"))
    obs = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("series_id"), F.to_date("l_shipdate").alias("observation_date"))
    return quality.inventory(obs, registry)
