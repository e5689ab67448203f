"""Plans that tell what features are worth, and how models do fold by fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import evaluate as E
from tidegauge.operators import information, ranges
from tidegauge.plans.base import CALLS, LABELS, calls, query, table

_CHANCE = {"cut": "p * 0.4", "hike": "p * 0.6", "hold": "1 - p"}
_METRICS = ("accuracy", "balanced_accuracy", "macro_f1", "log_loss", "brier")


@query("f9_folds_and_overall", f"""WITH {CALLS}, x AS (SELECT *, year(event_date) AS year, p * 0.4 AS pc, p * 0.6 AS ph, 1 - p AS po FROM c), k AS (SELECT year, label, count(*) FILTER (y_true = label AND y_pred = label) AS tp, count(*) FILTER (y_true <> label AND y_pred = label) AS fp,
    count(*) FILTER (y_true = label AND y_pred <> label) AS fn FROM x, (SELECT unnest(['cut', 'hike', 'hold']) AS label) GROUP BY GROUPING SETS ((year, label), (label))), m AS (SELECT year, avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END) AS b, sum(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 3 AS f FROM k GROUP BY 1),
    z AS (SELECT year, CAST(grouping(year) AS INTEGER) AS is_overall, count(*) AS n, avg(CAST(y_true = y_pred AS DOUBLE)) AS a, avg(-ln(greatest(least(CASE y_true WHEN 'cut' THEN pc WHEN 'hike' THEN ph ELSE po END, 1 - 2.220446049250313e-16), 2.220446049250313e-16))) AS l,
    avg(pow(pc - CAST(y_true = 'cut' AS DOUBLE), 2) + pow(ph - CAST(y_true = 'hike' AS DOUBLE), 2) + pow(po - CAST(y_true = 'hold' AS DOUBLE), 2)) AS r FROM x GROUP BY GROUPING SETS ((year), ()))
    SELECT z.year, is_overall, n, round(a, 6) AS accuracy, round(b, 6) AS balanced_accuracy, round(f, 6) AS macro_f1, round(l, 5) AS log_loss, round(r, 6) AS brier FROM z JOIN m ON z.year IS NOT DISTINCT FROM m.year""")  # fmt: skip
def _(spark, d):
    rows = calls(spark, d).withColumn("year", F.year("event_date"))
    found = E.bundle(rows, LABELS, ["year"], {k: F.expr(v) for k, v in _CHANCE.items()})
    return found.select("year", "is_overall", "n", *[F.round(c, 5 if c == "log_loss" else 6).alias(c) for c in _METRICS])


@query("f9_models_by_fold", f"""WITH {CALLS}, x AS (SELECT 'persistence' AS model, year(event_date) AS year, y_true, y_pred AS y FROM c UNION ALL SELECT 'hold', year(event_date), y_true, 'hold' FROM c), k AS (SELECT model, year, label, count(*) FILTER (y_true = label AND y = label) AS tp, count(*) FILTER (y_true <> label AND y = label) AS fp,
    count(*) FILTER (y_true = label AND y <> label) AS fn FROM x, (SELECT unnest(['cut', 'hike', 'hold']) AS label) GROUP BY GROUPING SETS ((model, year, label), (model, label))), m AS (SELECT model, year, avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END) AS b, sum(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 3 AS f FROM k GROUP BY 1, 2),
    z AS (SELECT model, year, CAST(grouping(year) AS INTEGER) AS is_overall, count(*) AS n, avg(CAST(y_true = y AS DOUBLE)) AS a FROM x GROUP BY GROUPING SETS ((model, year), (model)))
    SELECT z.model, z.year, is_overall, n, round(a, 6) AS accuracy, round(b, 6) AS balanced_accuracy, round(f, 6) AS macro_f1 FROM z JOIN m ON z.model = m.model AND z.year IS NOT DISTINCT FROM m.year""")  # fmt: skip
def _(spark, d):
    models = F.array(F.struct(F.lit("persistence").alias("model"), F.col("y_pred").alias("y")), F.struct(F.lit("hold").alias("model"), F.lit("hold").alias("y")))
    rows = calls(spark, d).select("y_true", F.year("event_date").alias("year"), F.explode(models).alias("m")).select("y_true", "year", "m.model", F.col("m.y").alias("y_pred"))
    found = E.bundle(rows, LABELS, ["model", "year"], sets=[["model", "year"], ["model"]])
    return found.select("model", "year", "is_overall", "n", *[F.round(c, 6).alias(c) for c in _METRICS[:3]])


_LONG = f"""{CALLS}, g AS (SELECT 'given' AS model, label, CASE label WHEN 'cut' THEN p * 0.4 WHEN 'hike' THEN p * 0.6 ELSE 1 - p END AS q, y_true FROM c, (SELECT unnest(['cut', 'hike', 'hold']) AS label) UNION ALL SELECT 'flat', label, 1 / 3, y_true FROM c, (SELECT unnest(['cut', 'hike', 'hold']) AS label)),
    e AS (SELECT CAST(i AS INTEGER) AS bin, CAST(i AS DOUBLE) / 5 AS low, CASE WHEN i = 4 THEN 1.0 ELSE CAST(i + 1 AS DOUBLE) / 5 END AS high FROM range(5) t(i)),
    r AS (SELECT model, label, bin, count(*) AS n, avg(q) AS m, avg(CAST(y_true = label AS DOUBLE)) AS h FROM g JOIN e ON q >= low AND (q < high OR high = 1.0) GROUP BY 1, 2, 3)"""


def _class_chances(spark, d):
    """(model, label, q, hit): the probability of every class by two models."""
    cells = [F.struct(F.lit(m).alias("model"), F.lit(k).alias("label"), F.expr(v).cast("double").alias("q")) for m, chance in (("given", _CHANCE), ("flat", dict.fromkeys(LABELS, "1.0D / 3"))) for k, v in chance.items()]
    return calls(spark, d).select("y_true", F.explode(F.array(*cells)).alias("c")).select("c.*", (F.col("y_true") == F.col("c.label")).cast("int").alias("hit"))


@query("f12_by_class_and_model", f"WITH {_LONG} SELECT model, label, round(sum(n * abs(m - h)) / sum(n), 6) AS ece, round(max(abs(m - h)), 6) AS mce FROM r GROUP BY 1, 2")
def _(spark, d):
    rows = _class_chances(spark, d)
    found = E.calibration_errors(E.reliability(rows, "q", "hit", [i / 5 for i in range(5)] + [1.0], ["model", "label"]), ["model", "label"])
    return found.select("model", "label", F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


@query("f11_quantile_bins_by_year", f"""WITH {CALLS}, x AS (SELECT *, year(event_date) AS year FROM c), q AS (SELECT year, list_sort(list_distinct(list_concat([0.0, 1.0], quantile_cont(p, [0.25, 0.5, 0.75])))) AS e FROM x GROUP BY 1), e AS (SELECT year, CAST(i AS INTEGER) AS bin, e[i + 1] AS low, e[i + 2] AS high FROM (SELECT year, e, unnest(range(len(e) - 1)) AS i FROM q))
    SELECT e.year, bin, round(low, 9) AS low, count(p) AS n, round(sum(p), 6) AS sum_pred FROM e LEFT JOIN x ON x.year = e.year AND p >= low AND (p < high OR high = 1.0) GROUP BY 1, 2, 3""")  # fmt: skip
def _(spark, d):
    rows = calls(spark, d).withColumn("year", F.year("event_date")).withColumn("hit", (F.col("y_true") == "hold").cast("int"))
    found = E.reliability(rows, "p", "hit", E.quantile_edges(rows, "p", 4, ["year"]), ["year"])
    return found.select("year", "bin", F.round("low", 9).alias("low"), "n", F.round(F.col("mean_pred") * F.col("n"), 6).alias("sum_pred"))  # sums have no ties in rounding


@query("f14_slices_by_flag_and_year", f"""WITH {CALLS}, x AS (SELECT year(event_date) AS year, CAST(y_true = y_pred AS DOUBLE) AS hit, value > 200000 AS large FROM c) SELECT year, 'large' AS flag, count(*) FILTER (large) AS n_on, round(avg(hit) FILTER (large), 6) AS accuracy_on,
    count(*) FILTER (NOT large) AS n_off, round(avg(hit) FILTER (NOT large), 6) AS accuracy_off FROM x GROUP BY 1 HAVING n_on > 0 AND n_off > 0""")  # fmt: skip
def _(spark, d):
    rows = calls(spark, d).withColumn("year", F.year("event_date")).withColumn("large", F.expr("value > 200000").cast("int"))
    return E.sliced(rows, ["large"], ["year"]).withColumns({c: F.round(c, 6) for c in ("accuracy_on", "accuracy_off")})


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("f26_quantiles", f"""SELECT l_returnflag, feature, share, round(value, 6) AS value FROM (SELECT l_returnflag, feature, unnest([0.0, 0.1, 0.5, 0.9, 1.0]) AS share, unnest(quantile_cont(v, [0.0, 0.1, 0.5, 0.9, 1.0])) AS value
    FROM (SELECT l_returnflag, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _MEASURES)} FROM lineitem) UNPIVOT (v FOR feature IN ({', '.join(_MEASURES)})) GROUP BY 1, 2)""")  # fmt: skip
def _(spark, d):
    return ranges.quantiles(table(spark, d, "lineitem"), _MEASURES, [0.0, 0.1, 0.5, 0.9, 1.0], ["l_returnflag"]).withColumn("value", F.round("value", 6))


_PSI = "ln({0} + 10) - 1 / (2 * ({0} + 10)) - 1 / (12 * pow({0} + 10, 2)) + 1 / (120 * pow({0} + 10, 4)) - 1 / (252 * pow({0} + 10, 6))" + "".join(f" - 1 / ({{0}} + {i})" for i in range(10))
_CONTINUOUS = {"l_extendedprice": "CAST(l_extendedprice AS DOUBLE)", "l_quantity": "CAST(l_quantity AS DOUBLE)", "rate": "CAST(l_extendedprice AS DOUBLE) * l_discount", "flat": "CAST(1.5 AS DOUBLE)", "few": "CASE WHEN l_orderkey = 1 THEN CAST(l_extendedprice AS DOUBLE) END"}
_FOR_LABEL = {"l_extendedprice": "l_returnflag"}


def _near_sql(name: str, expression: str) -> str:
    """The neighbour estimate of one column, by sorted neighbours of a row's class and cumulative counts looked up at both ends of its reach."""
    spans = ", ".join(f"CASE WHEN k >= {j} THEN greatest(coalesce(x - lag(x, {j}) OVER w, CASE WHEN {j} = 0 THEN 0.0 ELSE 'inf'::DOUBLE END), coalesce(lead(x, CAST(k - {j} AS INTEGER)) OVER w - x, CASE WHEN k = {j} THEN 0.0 ELSE 'inf'::DOUBLE END)) ELSE 'inf'::DOUBLE END" for j in range(4))
    return f"""SELECT * FROM (WITH x0 AS (SELECT l_returnflag AS y, {expression} AS x FROM lineitem), x1 AS (SELECT y, x, count(*) OVER (PARTITION BY y) AS n FROM x0 WHERE x IS NOT NULL), x2 AS (SELECT y, x, n, least(3, n - 1) AS k, count(*) OVER (PARTITION BY y, x) AS same FROM x1 WHERE n > 1),
      x3 AS (SELECT *, least({spans}) AS r FROM x2 WINDOW w AS (PARTITION BY y ORDER BY x)), u AS (SELECT v, sum(c) OVER (ORDER BY v) AS upto FROM (SELECT x AS v, count(*) AS c FROM x2 GROUP BY 1)),
      x4 AS (SELECT n, CASE WHEN r = 0 THEN same ELSE k END AS k, CASE WHEN r = 0 THEN x ELSE x - r END AS a, CASE WHEN r = 0 THEN x ELSE x + r END AS b, r FROM x3), x5 AS (SELECT x4.*, coalesce(u.upto, 0) AS hi FROM x4 ASOF LEFT JOIN u ON x4.b > u.v), x6 AS (SELECT x4.*, coalesce(u.upto, 0) AS lo FROM x5 x4 ASOF LEFT JOIN u ON x4.a >= u.v),
      x7 AS (SELECT *, CASE WHEN r = 0 THEN lo - hi ELSE hi - lo END AS m FROM x6)
      SELECT '{name}' AS feature, CASE WHEN (SELECT count(*) FROM x1) < 30 THEN NULL WHEN (SELECT min(x) = max(x) FROM x1) THEN 0.0 ELSE greatest(0, ({_PSI.format('max(tt)')}) + avg({_PSI.format('k')}) - avg({_PSI.format('n')}) - avg({_PSI.format('m')})) END AS mi FROM (SELECT *, count(*) OVER () AS tt FROM x7))"""


@query("f18_continuous", f"SELECT feature, round(mi, 7) AS mi FROM ({' UNION ALL '.join(_near_sql(k, v) for k, v in _CONTINUOUS.items())})")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", *[F.expr(v).alias(k) for k, v in _CONTINUOUS.items()])
    return information.continuous_information(rows, list(_CONTINUOUS), "l_returnflag").withColumn("mi", F.round("mi", 7))


_RANKED = {"l_extendedprice": "CAST(l_extendedprice AS DOUBLE)", "l_linenumber": "CAST(l_linenumber AS DOUBLE)", "l_quantity": "CAST(l_quantity AS DOUBLE)"}


@query("f19_ranked_by_information", f"""WITH m AS ({' UNION ALL '.join(_near_sql(k, v) for k, v in _RANKED.items() if k != 'l_linenumber')} UNION ALL SELECT 'l_linenumber', sum(n / t * ln(n * t / (nx * ny))) FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY l_linenumber) AS nx, sum(n) OVER (PARTITION BY l_returnflag) AS ny
    FROM (SELECT l_linenumber, l_returnflag, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2))), p AS ({' UNION ALL '.join(f"SELECT '{k}' AS feature, corr({v}, l_tax) AS pearson FROM lineitem" for k, v in _RANKED.items())})
    SELECT feature, round(mi, 7) AS mi, round(pearson, 6) AS pearson FROM m JOIN p USING (feature) ORDER BY m.mi DESC NULLS LAST, abs(p.pearson) DESC NULLS LAST, feature LIMIT 2""")  # fmt: skip
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_tax").cast("double").alias("l_tax"), *[F.expr(v).alias(k) for k, v in _RANKED.items()])
    scores = information.information(rows, list(_RANKED), "l_returnflag").join(E.correlations(rows, list(_RANKED), "l_tax"), "feature")
    return E.ranked(scores, ["mi", "pearson"], 2).select("feature", F.round("mi", 7).alias("mi"), F.round("pearson", 6).alias("pearson"))
