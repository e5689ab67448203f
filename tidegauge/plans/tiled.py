"""Plans over panels in tiles, fold statistics by running sums, and linear rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import baselines as B
from tidegauge.operators import features
from tidegauge.operators.tiles import Tiled, carry_by_fold, filled_in_folds, fold_statistics
from tidegauge.plans.base import CALLS, LABELS, ORDERS, PANEL, W, calls, orders, query
from tidegauge.plans.panel import _roll_sql
from tidegauge.plans.scoring import _FOLDS

#: Small ones, so that the given tables' customers fill several.
SIZE = 8


def _tiled(spark, d, size: int = SIZE) -> Tiled:
    return Tiled.of(orders(spark, d).select("entity", "event_date", "value"), PANEL, size, 20_000)


@query("e1_lags_tiled", f"WITH {ORDERS} SELECT entity, event_date, {', '.join(f'lag(value, {h}) OVER {W} AS value_lag_{h}' for h in (1, 2, 3, 6))} FROM o")
def _(spark, d):
    return _tiled(spark, d).lags(["value"], (1, 2, 3, 6)).rows.drop("value")


@query("e3_rolling_tiled", f"WITH {ORDERS} SELECT entity, event_date, {', '.join(_roll_sql(w, s, f'value_roll_{w}_{s}') for w in (3, 6) for s in ('mean', 'std', 'min', 'max', 'zscore'))} FROM o")
def _(spark, d):
    wide = _tiled(spark, d).rolling(["value"], (3, 6)).rows.drop("value")
    return wide.select("entity", "event_date", *[F.round(c, 6 if c.endswith("mean") else 3).alias(c) for c in wide.columns[2:]])


@query("e5_ewma_tiled", f"""WITH {ORDERS}, r AS (SELECT entity, event_date, value, row_number() OVER {W} AS pos FROM o)
    SELECT a.entity, a.event_date, round(sum(b.value * power(1 - 2.0 / 7, a.pos - b.pos)) / sum(power(1 - 2.0 / 7, a.pos - b.pos)), 6) AS value_ewma_6
    FROM r a JOIN r b ON a.entity = b.entity AND b.pos <= a.pos GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    return _tiled(spark, d).ewma("value", 6).rows.select("entity", "event_date", F.round("value_ewma_6", 6).alias("value_ewma_6"))


@query("e12_trend_gap_tiled", f"""WITH {ORDERS} SELECT entity, event_date, CASE WHEN count(value) OVER w >= 4 THEN round(avg(value) OVER w - value, 6) END AS gap
    FROM o WINDOW w AS (PARTITION BY entity ORDER BY event_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")  # fmt: skip
def _(spark, d):
    return _tiled(spark, d).trend_gap("value", "gap", 12).rows.select("entity", "event_date", F.round("gap", 6).alias("gap"))


@query("e13_forward_fill_tiled", f"""WITH {ORDERS}, x AS (SELECT entity, event_date, CASE WHEN value > 150000 THEN value END AS v FROM o)
    SELECT entity, event_date, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY entity ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS filled FROM x""")  # fmt: skip
def _(spark, d):
    rows = orders(spark, d).select("entity", "event_date", F.when(F.col("value") > 150000, F.col("value")).alias("v"))
    return Tiled.of(rows, PANEL, SIZE, 20_000).forward_filled("v", "filled").rows.drop("v")


@query("d11_fold_statistics", f"""WITH {CALLS}, n AS (SELECT entity, count(*) AS n FROM c GROUP BY 1), f AS (SELECT entity, CAST(i AS INTEGER) AS fold, 5 + 2 * i AS test_lo FROM (SELECT entity, n, unnest(range(0, (n - 2 - 5) // 2 + 1)) AS i FROM n WHERE n >= 7)), p AS (SELECT entity, value, y_true, row_number() OVER {W} - 1 AS pos FROM c)
    SELECT entity, fold, CAST(pos >= test_lo AS INTEGER) AS is_test, count(*) AS n, round(avg(value), 4) AS value_mean, round(var_samp(value) / 1e6, 3) AS value_var, {', '.join(f"count(*) FILTER (y_true = '{x}') AS y_true_{x}" for x in LABELS)} FROM p JOIN f USING (entity) WHERE pos < test_lo + 2 GROUP BY 1, 2, 3""")  # fmt: skip
def _(spark, d):
    rows = calls(spark, d).select("entity", "event_date", "value", "y_true")
    found = fold_statistics(rows, PANEL, B.folds(rows, ["entity"], 5, 2, 2), ["value"], {"y_true": LABELS}, SIZE, 20_000)
    return found.select("entity", "fold", "is_test", "n", F.round("value_mean", 4).alias("value_mean"), F.round(F.col("value_var") / 1e6, 3).alias("value_var"), *[f"y_true_{x}" for x in LABELS])


@query("j8_rolling_folds", f"""WITH {_FOLDS} SELECT entity, fold, greatest(test_lo - 4, 0) AS train_lo, test_lo AS train_hi, test_lo, test_lo + 2 AS test_hi FROM f""")
def _(spark, d):
    return B.folds(orders(spark, d), ["entity"], 5, 2, 2, rolling=4)


_RULE = f"""{ORDERS}, x0 AS (SELECT *, lag(value) OVER {W} AS before, (date_diff('day', lag(event_date) OVER {W}, event_date)) / 100 AS gap FROM o), x1 AS (SELECT *, CASE WHEN before IS NOT NULL AND value IS NOT NULL THEN wt END AS u FROM (SELECT *, 1 + day(event_date) % 3 AS wt FROM x0)),
    s AS (SELECT entity, event_date, value, before, gap, count(u) OVER b AS n, sum(u) OVER b AS sw, sum(u * before) OVER b AS s1, sum(u * gap) OVER b AS s2, sum(u * value) OVER b AS sy, sum(u * before * before) OVER b AS p11, sum(u * before * gap) OVER b AS p12, sum(u * gap * gap) OVER b AS p22, sum(u * before * value) OVER b AS p1y, sum(u * gap * value) OVER b AS p2y FROM x1
          WINDOW b AS (PARTITION BY entity ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    a AS (SELECT *, p11 - s1 * s1 / sw AS a11, p12 - s1 * s2 / sw AS a12, p22 - s2 * s2 / sw AS a22, p1y - s1 * sy / sw AS a1y, p2y - s2 * sy / sw AS a2y FROM s),
    k AS (SELECT *, a11 * a22 - a12 * a12 AS det FROM a), r AS (SELECT *, CASE WHEN n >= 6 THEN (a1y * a22 - a2y * a12) / det END AS b1, CASE WHEN n >= 6 THEN (a2y * a11 - a1y * a12) / det END AS b2 FROM k), t AS (SELECT *, (sy - b1 * s1 - b2 * s2) / sw AS b0 FROM r)"""


@query("j3_policy_rule", f"""WITH {_RULE}, v AS (SELECT *, b0 + b1 * before + b2 * gap AS q FROM t)
    SELECT entity, event_date, round(b0, 2) AS intercept, round(b1, 4) AS slope_before, round(b2, 2) AS slope_gap, CASE WHEN q - before > 20000 THEN 'hike' WHEN q - before < -20000 THEN 'cut' WHEN q IS NOT NULL AND before IS NOT NULL THEN 'hold' END AS call FROM v""")  # fmt: skip
def _(spark, d):
    w = PANEL.window
    rows = orders(spark, d).withColumn("before", F.lag("value").over(w)).withColumn("gap", F.date_diff("event_date", F.lag("event_date").over(w)) / 100.0).withColumn("wt", 1 + F.day("event_date") % 3)
    found = B.policy_rule(rows, PANEL, ["before", "gap"], "value", "wt", least=6)
    call = B.direction(F.col("prescribed"), F.col("before"), 20000.0)
    return found.select("entity", "event_date", F.round("intercept", 2).alias("intercept"), F.round("slope_before", 4).alias("slope_before"), F.round("slope_gap", 2).alias("slope_gap"), call.alias("call"))


@query("j3_given_rule", f"""WITH {ORDERS}, x AS (SELECT *, lag(value) OVER {W} AS before, date_diff('day', lag(event_date) OVER {W}, event_date) AS gap FROM o), q AS (SELECT *, 1000.0 + 0.9 * before + 120.0 * gap AS q FROM x)
    SELECT entity, event_date, round(q, 4) AS prescribed, CASE WHEN q - before > 5000 THEN 'hike' WHEN q - before < -5000 THEN 'cut' WHEN q IS NOT NULL THEN 'hold' END AS call FROM q""")  # fmt: skip
def _(spark, d):
    rows = orders(spark, d).select("entity", "event_date", F.lag("value").over(PANEL.window).alias("before"), *features.since_previous(PANEL, "event_date", "value")[:1])
    rule = B.given_rule({"before": 0.9, "gap_days": 120.0}, 1000.0)
    return rows.select("entity", "event_date", F.round(rule, 4).alias("prescribed"), B.direction(rule, F.col("before"), 5000.0).alias("call"))


_GAPS = f"""{_FOLDS}, g AS (SELECT entity, event_date, CASE WHEN value > 150000 THEN value END AS v, row_number() OVER {W} - 1 AS pos FROM o),
    k AS (SELECT f.entity, fold, test_lo, arg_max(v, pos) FILTER (v IS NOT NULL) AS carry FROM f JOIN g ON g.entity = f.entity AND pos >= test_lo - 6 AND pos < test_lo GROUP BY 1, 2, 3)"""


def _with_gaps(spark, d):
    rows = orders(spark, d).select("entity", "event_date", F.when(F.col("value") > 150000, F.col("value")).alias("v"))
    return rows, B.folds(rows, ["entity"], 5, 2, 2, rolling=6)


@query("e13_carry_by_fold", f"WITH {_GAPS} SELECT entity, fold, carry FROM k")
def _(spark, d):
    rows, folds = _with_gaps(spark, d)
    return carry_by_fold(rows, PANEL, "v", folds, SIZE, 20_000)


@query("e13_filled_in_folds", f"""WITH {_GAPS} SELECT k.entity, fold, event_date, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY k.entity, fold ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), carry, 0) AS filled
    FROM k JOIN g ON g.entity = k.entity AND pos >= test_lo AND pos < test_lo + 2""")  # fmt: skip
def _(spark, d):
    rows, folds = _with_gaps(spark, d)
    return filled_in_folds(rows, PANEL, "v", folds, "filled", SIZE, 20_000)
