"""Plans over keyed panels: as-of joins, features and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import scalars as S
from tidegauge.operators import asof, evaluate, features, targets
from tidegauge.operators.features import Panel
from tidegauge.plans.base import EVENTS, ORDERS, PANEL, W, events, orders, query, table

TYPES = ["click", "error", "purchase", "signup", "view"]


def _published(spark, d, days=7):
    o = orders(spark, d)
    return o.select("entity", F.lit("orders").alias("series_id"), F.col("event_date").alias("observation_date"), F.date_add("event_date", days).alias("publication_date"), "value")


def _asof_sql(compare: str, extra: str = "") -> str:
    return f"""WITH {ORDERS}, b AS (SELECT entity AS e, event_date + 7 AS pub, value AS v FROM o)
    SELECT entity, event_date, {extra.format(c='v') or 'v'} AS value, CAST({extra.format(c="date_diff('day', pub, event_date)") or "date_diff('day', pub, event_date)"} AS INTEGER) AS age_days,
           CAST(({extra.format(c='v') or 'v'}) IS NULL AS INTEGER) AS is_missing
    FROM o ASOF LEFT JOIN b ON o.entity = b.e AND b.pub {compare} o.event_date"""


@query("d1_asof_strict", _asof_sql("<"))
def _(spark, d):
    return asof.as_of(orders(spark, d), _published(spark, d), ["entity"])


@query("d1_asof_bucketed", _asof_sql("<"))
def _(spark, d):
    return asof.as_of(orders(spark, d), _published(spark, d), ["entity"], bucket_days=400)


@query("a1_long_contract", "SELECT event_type AS series_id, CAST(ts AS DATE) AS observation_date, CASE WHEN user_id % 7 > 0 THEN CAST(ts AS DATE) + 2 END AS publication_date, value, user_id AS entity FROM events WHERE value IS NOT NULL")
def _(spark, d):
    day = F.to_date("ts")
    raw = table(spark, d, "events").select(F.col("value").cast("string").alias("value"), F.when(F.col("user_id") % 7 > 0, F.date_add(day, 2).cast("string")).alias("publication_date"), day.cast("string").alias("observation_date"), F.col("event_type").alias("series_id"), F.col("user_id").alias("entity"))
    return asof.conform(raw)


@query("d2_asof_tolerance", _asof_sql("<=", "CASE WHEN date_diff('day', pub, event_date) <= 120 THEN {c} END"))
def _(spark, d):
    return asof.as_of(orders(spark, d), _published(spark, d), ["entity"], strict=False, within_days=120)


_SPINE = "s AS (SELECT DISTINCT user_id AS entity, CAST(ts AS DATE) AS event_date FROM events)"


@query("d5_wide_assembly", f"""WITH {EVENTS}, {_SPINE}, t AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS series_id),
    j AS (SELECT s.entity, s.event_date, t.series_id, l.value, CAST(date_diff('day', l.publication_date, s.event_date) AS INTEGER) AS age FROM (s CROSS JOIN t)
          ASOF LEFT JOIN l ON s.entity = l.entity AND t.series_id = l.series_id AND l.publication_date < s.event_date)
    SELECT entity, event_date, {', '.join(f"max(value) FILTER (series_id = '{x}') AS {x}, max(age) FILTER (series_id = '{x}') AS {x}_age_days, max(CAST(value IS NULL AS INTEGER)) FILTER (series_id = '{x}') AS {x}_is_missing" for x in TYPES)}
    FROM j GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    spine = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("event_date")).distinct()
    return asof.assemble_wide(spine, events(spark, d), ["entity"], TYPES)


@query("d5_source_collisions", """SELECT series_id, count(*) AS n_sources FROM (SELECT DISTINCT o_orderpriority AS series_id, 'a' AS s FROM orders
    UNION ALL SELECT DISTINCT o_orderpriority, 'b' FROM orders WHERE o_totalprice > 400000) GROUP BY 1 HAVING count(*) > 1""")  # fmt: skip
def _(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "series_id")
    return asof.sources_collide({"a": o, "b": o.filter("o_totalprice > 400000")})


@query("d7_enrichment", """SELECT o_orderkey, o_custkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    known = asof.enriched(c, n, {"c_nationkey": "n_nationkey"}, ["n_name"])
    return asof.enriched(o, known, {"o_custkey": "c_custkey"}, ["c_mktsegment", "n_name"]).select("o_orderkey", "o_custkey", "c_mktsegment", "n_name")


@query("d10_lookup_last", """WITH k AS (SELECT l_partkey, l_suppkey, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_quantity)) AS l_quantity FROM lineitem GROUP BY 1, 2)
    SELECT p_partkey, s_suppkey, l_quantity FROM (SELECT DISTINCT l_partkey AS p_partkey, l_suppkey AS s_suppkey FROM lineitem UNION SELECT p_partkey, CAST(0 AS BIGINT) FROM part) LEFT JOIN k ON p_partkey = l_partkey AND s_suppkey = l_suppkey""")  # fmt: skip
def _(spark, d):
    right = table(spark, d, "lineitem").withColumnsRenamed({"l_partkey": "p_partkey", "l_suppkey": "s_suppkey"})
    absent = table(spark, d, "part").select("p_partkey", F.lit(0).cast("long").alias("s_suppkey"))  # no such supplier
    keys = right.select("p_partkey", "s_suppkey").unionByName(absent).distinct()
    return asof.lookup_latest(keys, right, ["p_partkey", "s_suppkey"], "l_quantity", ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity"])


@query("e1_lags", f"WITH {ORDERS} SELECT entity, event_date, {', '.join(f'lag(value, {h}) OVER {W} AS value_lag_{h}' for h in (1, 2, 3, 6, 12))} FROM o")
def _(spark, d):
    return orders(spark, d).select("entity", "event_date", *features.lags(PANEL, ["value"]))


def _roll_sql(w: int, what: str, name: str) -> str:
    over = f"OVER (PARTITION BY entity ORDER BY event_date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    of = {"mean": "avg(value) {o}", "std": "stddev_samp(value) {o}", "min": "min(value) {o}", "max": "max(value) {o}", "zscore": "(value - avg(value) {o}) / nullif(stddev_samp(value) {o}, 0)"}[what].format(o=over)
    return f"CASE WHEN count(value) {over} = {w} THEN round({of}, {6 if what == 'mean' else 3}) END AS {name}"


@query("e3_rolling", f"WITH {ORDERS} SELECT entity, event_date, {', '.join(_roll_sql(w, s, f'value_roll_{w}_{s}') for w in (3, 6, 12) for s in ('mean', 'std', 'min', 'max', 'zscore'))} FROM o")
def _(spark, d):
    wide = orders(spark, d).select("entity", "event_date", *features.rolling(PANEL, ["value"]))
    return wide.select("entity", "event_date", *[F.round(c, 6 if c.endswith("mean") else 3).alias(c) for c in wide.columns[2:]])


@query("e5_ewma", f"""WITH {ORDERS}, r AS (SELECT entity, event_date, value, row_number() OVER {W} AS pos FROM o)
    SELECT a.entity, a.event_date, round(sum(b.value * power(1 - 2.0 / 7, a.pos - b.pos)) / sum(power(1 - 2.0 / 7, a.pos - b.pos)), 6) AS value_ewma_6
    FROM r a JOIN r b ON a.entity = b.entity AND b.pos <= a.pos GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    return features.ewma(orders(spark, d), PANEL, "value", 6).select("entity", "event_date", F.round("value_ewma_6", 6).alias("value_ewma_6"))


@query("e6_changes", f"""WITH {ORDERS} SELECT entity, event_date, {', '.join(f'round(value - lag(value, {h}) OVER {W}, 3) AS value_diff_{h}' for h in (1, 3, 6, 12))},
    {', '.join(f'round((value - lag(value, {h}) OVER {W}) / nullif(lag(value, {h}) OVER {W}, 0), 5) AS value_pct_{h}' for h in (1, 3, 12))} FROM o""")  # fmt: skip
def _(spark, d):
    wide = orders(spark, d).select("entity", "event_date", *features.changes(PANEL, ["value"]))
    return wide.select("entity", "event_date", *[F.round(c, 3 if "diff" in c else 5).alias(c) for c in wide.columns[2:]])


@query("e8_year_on_year", f"""WITH {ORDERS} SELECT a.entity, a.event_date, round((a.value - b.value) / nullif(b.value, 0), 5) AS value_yoy_pct
    FROM o a ASOF LEFT JOIN o b ON a.entity = b.entity AND b.event_date <= a.event_date - 365""")  # fmt: skip
def _(spark, d):
    return orders(spark, d).select("entity", "event_date", F.round(features.year_on_year(PANEL, "value", "event_date"), 5).alias("value_yoy_pct"))


@query("e10_gap_and_previous", f"WITH {ORDERS} SELECT entity, event_date, CAST(date_diff('day', lag(event_date) OVER {W}, event_date) AS INTEGER) AS gap_days, lag(value) OVER {W} AS previous_value FROM o")
def _(spark, d):
    return orders(spark, d).select("entity", "event_date", *features.since_previous(PANEL, "event_date", "value"))


@query("e11_cycle_phase", f"""WITH {ORDERS}, x AS (SELECT *, value - lag(value, 3) OVER {W} AS dv FROM o)
    SELECT entity, event_date, CASE WHEN dv > 10000 THEN 'tightening' WHEN dv < -10000 THEN 'easing' ELSE 'on-hold' END AS phase FROM x""")  # fmt: skip
def _(spark, d):
    return orders(spark, d).select("entity", "event_date", features.cycle_phase(PANEL, "value", threshold=10000.0).alias("phase"))


@query("e12_trend_gap", f"""WITH {ORDERS} SELECT entity, event_date, CASE WHEN count(value) OVER w >= 4 THEN round(avg(value) OVER w - value, 6) END AS gap
    FROM o WINDOW w AS (PARTITION BY entity ORDER BY event_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")  # fmt: skip
def _(spark, d):
    return orders(spark, d).select("entity", "event_date", F.round(features.trend_gap(PANEL, "value"), 6).alias("gap"))


@query("e13_forward_fill", f"""WITH {ORDERS}, x AS (SELECT entity, event_date, CASE WHEN value > 150000 THEN value END AS v FROM o)
    SELECT entity, event_date, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY entity ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS filled FROM x""")  # fmt: skip
def _(spark, d):
    return orders(spark, d).withColumn("v", F.when(F.col("value") > 150000, F.col("value"))).select("entity", "event_date", features.forward_filled(PANEL, "v").alias("filled"))


_SPLIT = "DATE '1997-01-01'"


@query("e14_splice", f"""WITH {ORDERS}, old AS (SELECT * FROM o), nw AS (SELECT entity, event_date, value * 2 AS value FROM o WHERE event_date >= {_SPLIT}),
    st AS (SELECT entity, min(event_date) AS s, arg_min(value, event_date) AS nv FROM nw GROUP BY 1),
    f AS (SELECT st.entity, nv / nullif(old.value, 0) AS f FROM st JOIN old ON old.entity = st.entity AND old.event_date = st.s)
    SELECT old.entity, event_date, round(value * coalesce(f, 1), 2) AS value FROM old LEFT JOIN st USING (entity) LEFT JOIN f USING (entity) WHERE s IS NULL OR event_date < s
    UNION ALL SELECT entity, event_date, round(value, 2) FROM nw""")  # fmt: skip
def _(spark, d):
    o = orders(spark, d)
    new = o.filter("event_date >= '1997-01-01'").withColumn("value", F.col("value") * 2)
    return features.spliced(o, new, ["entity"], "event_date", "value").withColumn("value", F.round("value", 2))


@query("e15_future_row", f"""WITH {ORDERS} SELECT entity, event_date, value, NULL::DOUBLE AS previous_value, NULL::INTEGER AS gap_days FROM o
    UNION ALL SELECT entity, DATE '2030-01-15', NULL, arg_max(value, event_date), CAST(date_diff('day', max(event_date), DATE '2030-01-15') AS INTEGER) FROM o GROUP BY entity""")  # fmt: skip
def _(spark, d):
    return features.append_future(orders(spark, d), PANEL, "event_date", "value", "2030-01-15")


@query("b1_signed_number", """SELECT conv_id, turn, CASE WHEN contains(t, 'to') THEN NULL ELSE TRY_CAST(replace(replace(trim(t), '−', '-'), '+', '') AS DOUBLE) END AS number
    FROM (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '+' || turn || '.25' WHEN 1 THEN '−0.' || turn WHEN 2 THEN '15.00 to ' || conv_id WHEN 3 THEN ' ' || conv_id || ' ' ELSE role END AS t FROM conversations)""")  # fmt: skip
def _(spark, d):
    c = table(spark, d, "conversations")
    k = F.col("turn") % 5
    text = F.when(k == 0, F.concat(F.lit("+"), "turn", F.lit(".25"))).when(k == 1, F.concat(F.lit("−0."), "turn")).when(k == 2, F.concat(F.lit("15.00 to "), "conv_id")).when(k == 3, F.concat(F.lit(" "), "conv_id", F.lit(" "))).otherwise(F.col("role"))
    return c.select("conv_id", "turn", S.signed_number(text).alias("number"))


@query("b3_spine", f"""WITH {ORDERS}, x AS (SELECT *, lag(value) OVER {W} AS prior_value, CAST(date_diff('day', lag(event_date) OVER {W}, event_date) AS INTEGER) AS gap_days FROM o)
    SELECT entity, event_date, value, prior_value, gap_days FROM x WHERE event_date >= DATE '1996-01-01'""")  # fmt: skip
def _(spark, d):
    return targets.event_spine(orders(spark, d).select("entity", "event_date", "value"), PANEL, "event_date", "value", "1996-01-01")


@query("b4_date_shift", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1996-01-01' THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) - 1 END AS decided FROM orders")
def _(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", S.shifted(day, "1996-01-01").alias("decided"))


@query("b5_sign_target", f"""WITH {ORDERS}, x AS (SELECT *, value - lag(value) OVER {W} AS c FROM o)
    SELECT entity, event_date, CASE WHEN c < 0 THEN 'cut' WHEN c > 0 THEN 'hike' ELSE 'hold' END AS label FROM x WHERE c IS NOT NULL""")  # fmt: skip
def _(spark, d):
    change = F.col("value") - F.lag("value").over(PANEL.window)
    return orders(spark, d).select("entity", "event_date", S.label_of_sign(change).alias("label")).filter("label is not null")


@query("b6_bins_target", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_discount * 100, 0) AS INTEGER) AS bps FROM lineitem WHERE round_even(l_discount * 100, 0) IN (0, 2, 5)")
def _(spark, d):
    bps = F.bround(F.col("l_discount") * 100, 0).cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", bps.alias("bps")).filter(F.col("bps").isin(0, 2, 5))


@query("b9_regimes", """SELECT o_orderkey, CAST(day < DATE '1994-01-01' AS INTEGER) AS regime_early, CAST(day >= DATE '1994-01-01' AND day < DATE '1997-01-01' AS INTEGER) AS regime_middle,
    CAST(day >= DATE '1997-01-01' AS INTEGER) AS regime_late FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)""")  # fmt: skip
def _(spark, d):
    day = F.to_date("o_orderdate")
    eras = {"early": (None, "1994-01-01"), "middle": ("1994-01-01", "1997-01-01"), "late": ("1997-01-01", None)}
    return table(spark, d, "orders").select("o_orderkey", *[S.era(day, *e).alias(f"regime_{n}") for n, e in eras.items()])


@query("b13_period_ends", "SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS month_end, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS quarter_end FROM orders")
def _(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", S.month_end(day).alias("month_end"), S.quarter_end(day).alias("quarter_end"))


@query("b14_period_strings", """SELECT o_orderkey, last_day(make_date(year(o_orderdate), CASE WHEN o_orderkey % 2 = 0 THEN 3 * quarter(o_orderdate) ELSE month(o_orderdate) END, 1)) AS period_end FROM orders""")
def _(spark, d):
    day = F.to_date("o_orderdate")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.year(day), F.lit("-Q"), F.quarter(day))).otherwise(F.date_format(day, "yyyy-MM"))
    return table(spark, d, "orders").select("o_orderkey", S.period_end(text).alias("period_end"))


@query("b15_feature_groups", """SELECT n, count(*) AS items, CASE WHEN n LIKE '%\\_is\\_missing' ESCAPE '\\' THEN 'missing_flag' WHEN n LIKE '%\\_age\\_days' ESCAPE '\\' THEN 'staleness' WHEN n LIKE 'regime\\_%' ESCAPE '\\' THEN 'regime'
    WHEN n LIKE '%\\_surprise' ESCAPE '\\' THEN 'surprise' WHEN contains(n, '_roll_') THEN 'rolling' WHEN contains(n, '_lag_') THEN 'lag' WHEN regexp_matches(n, '_(diff|pct)_\\d+$|_yoy_pct$') THEN 'change' ELSE 'level' END AS grp
    FROM (SELECT p_brand || ['_is_missing', '_age_days', '_surprise', '_roll_3_mean', '_lag_2', '_diff_1', '_yoy_pct', ''][1 + p_partkey % 8] AS n FROM part) GROUP BY 1""")  # fmt: skip
def _(spark, d):
    ends = F.array(*[F.lit(x) for x in ("_is_missing", "_age_days", "_surprise", "_roll_3_mean", "_lag_2", "_diff_1", "_yoy_pct", "")])
    names = table(spark, d, "part").select(F.concat("p_brand", F.get(ends, (F.col("p_partkey") % 8).cast("int"))).alias("n"))
    return names.groupBy("n").agg(F.count(F.lit(1)).alias("items")).select("n", "items", features.feature_group(F.col("n")).alias("grp"))


@query("b17_surprise", "SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_quantity * p_retailprice, 2) AS price_surprise FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * F.col("p_retailprice")).alias("expected"))
    return rows.select("l_orderkey", "l_linenumber", *features.surprises({"price": "expected"})).withColumn("price_surprise", F.round("price_surprise", 2))


@query("b18_label_map", "SELECT doc_id, CASE toxic WHEN 0 THEN 'clean' WHEN 1 THEN 'toxic' END AS label FROM labels")
def _(spark, d):
    return table(spark, d, "labels").select("doc_id", S.mapped(F.col("toxic"), {0: "clean", 1: "toxic"}).alias("label"))


@query("g2_top_share", """SELECT p_brand, total, round(total / sum(total) OVER (), 5) AS share FROM (SELECT p_brand, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1) ORDER BY total DESC, p_brand LIMIT 10""")
def _(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.round(F.sum("p_retailprice"), 2).alias("total"))
    return evaluate.top_share(rows, "p_brand", "total", 10).withColumn("share", F.round("share", 5))


@query("e_features_long_series", f"""WITH {EVENTS} SELECT entity, series_id, observation_date, lag(value) OVER w AS value_lag_1, round(value - lag(value) OVER w, 4) AS value_diff_1 FROM l
    WINDOW w AS (PARTITION BY entity, series_id ORDER BY observation_date)""")  # fmt: skip
def _(spark, d):
    p = Panel(("entity", "series_id"), ("observation_date",))
    rows = events(spark, d).select("entity", "series_id", "observation_date", *features.lags(p, ["value"], (1,)), *features.changes(p, ["value"], (1,), ()))
    return rows.withColumn("value_diff_1", F.round("value_diff_1", 4))
