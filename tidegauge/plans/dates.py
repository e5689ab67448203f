"""Plans over release calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import calendars as C
from tidegauge.operators import quality
from tidegauge.plans.base import EVENTS, events, query, table

DAY = "CAST(o_orderdate AS DATE)"


def _days(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))


def _nth(month: str, dow: int, n: int) -> str:
    """SQL for the n-th weekday (Sunday 0) of a month given by its first day."""
    return f"CAST({month} + CAST(({dow} - dayofweek({month}) + 7) % 7 + 7 * ({n} - 1) AS INTEGER) AS DATE)"


def _month(d: str, plus: int = 0) -> str:
    return f"CAST(date_trunc('month', {d}) + INTERVAL {plus} MONTH AS DATE)"


@query("c1_nth_weekday", f"SELECT o_orderkey, {_nth(_month(DAY), 4, 2)} AS second_thursday, {_nth(_month(DAY), 2, 4)} AS fourth_tuesday FROM orders")
def _(spark, d):
    return _days(spark, d).select("o_orderkey", C.nth_weekday(F.col("d"), "THU", 2).alias("second_thursday"), C.nth_weekday(F.col("d"), "TUE", 4).alias("fourth_tuesday"))


@query("c2_last_named_weekday", f"SELECT o_orderkey, CAST(last_day({DAY}) - CAST((dayofweek(last_day({DAY})) - 3 + 7) % 7 AS INTEGER) AS DATE) AS last_wednesday FROM orders")
def _(spark, d):
    return _days(spark, d).select("o_orderkey", C.last_weekday(F.col("d"), "WED").alias("last_wednesday"))


@query("c3_last_working_day", f"SELECT o_orderkey, CAST(last_day({DAY}) - CASE dayofweek(last_day({DAY})) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS DATE) AS last_working_day FROM orders")
def _(spark, d):
    return _days(spark, d).select("o_orderkey", C.last_working_day(F.col("d")).alias("last_working_day"))


_HOLIDAYS = f"""y AS (SELECT CAST(unnest(range(1992, 2003)) AS INTEGER) AS y), fixed AS (SELECT make_date(y, m, dd) AS d FROM y, (VALUES (1, 1), (7, 4), (11, 11), (12, 25)) v(m, dd)),
    h AS (SELECT CASE dayofweek(d) WHEN 6 THEN d - 1 WHEN 0 THEN d + 1 ELSE d END AS d FROM fixed
          UNION SELECT {_nth('make_date(y, 1, 1)', 1, 3)} FROM y UNION SELECT {_nth('make_date(y, 2, 1)', 1, 3)} FROM y UNION SELECT {_nth('make_date(y, 9, 1)', 1, 1)} FROM y
          UNION SELECT {_nth('make_date(y, 10, 1)', 1, 2)} FROM y UNION SELECT {_nth('make_date(y, 11, 1)', 4, 4)} FROM y
          UNION SELECT CAST(make_date(y, 5, 31) - CAST((dayofweek(make_date(y, 5, 31)) - 1 + 7) % 7 AS INTEGER) AS DATE) FROM y),
    cal AS (SELECT CAST(unnest(generate_series(DATE '1992-01-01', DATE '2002-12-31', INTERVAL 1 DAY)) AS DATE) AS d),
    w AS (SELECT d FROM cal WHERE dayofweek(d) NOT IN (0, 6) AND d NOT IN (SELECT d FROM h))"""


def _working(spark):
    calendar = C.days(spark, "1992-01-01", "2002-12-31")
    return calendar, C.working_days(calendar, C.us_federal_holidays(spark, 1992, 2002))


@query("c4_holidays", f"WITH {_HOLIDAYS} SELECT h.d AS holiday, count(o_orderkey) AS n_orders FROM h LEFT JOIN orders ON CAST(o_orderdate AS DATE) = h.d GROUP BY 1")
def _(spark, d):
    h = C.us_federal_holidays(spark, 1992, 2002)
    return h.join(_days(spark, d), F.col("d") == F.col("holiday"), "left").groupBy("holiday").agg(F.count("o_orderkey").alias("n_orders"))


@query("c4_easter", """WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders),
    p AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), q AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM p),
    r AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS k FROM q), s AS (SELECT *, h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114 AS n FROM r)
    SELECT y AS year, make_date(y, n // 31, n % 31 + 1) AS easter FROM s""")  # fmt: skip
def _(spark, d):
    return _days(spark, d).select(F.year("d").alias("year")).distinct().select("year", C.easter(F.col("year")).alias("easter"))


@query("c4_australian_holidays", f"""WITH p AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM (SELECT CAST(unnest(range(1992, 2003)) AS INTEGER) AS y)), q AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM p),
    r AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS k FROM q), s AS (SELECT *, h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114 AS n FROM r), e AS (SELECT y, make_date(y, n // 31, n % 31 + 1) AS e FROM s),
    f AS (SELECT make_date(y, m, dd) AS d FROM e, (VALUES (1, 1), (1, 26), (12, 25), (12, 26)) v(m, dd)),
    h AS (SELECT CASE dayofweek(d) WHEN 6 THEN d + 2 WHEN 0 THEN d + 1 ELSE d END AS d FROM f UNION SELECT make_date(y, 4, 25) FROM e UNION SELECT e - 2 FROM e UNION SELECT e + 1 FROM e
          UNION SELECT {_nth('make_date(y, 6, 1)', 1, 2)} FROM e UNION SELECT {_nth('make_date(y, 10, 1)', 1, 1)} FROM e)
    SELECT CAST(h.d AS DATE) AS holiday, count(o_orderkey) AS n_orders FROM h LEFT JOIN orders ON CAST(o_orderdate AS DATE) = h.d GROUP BY 1""")  # fmt: skip
def _(spark, d):
    h = C.australian_holidays(spark, 1992, 2002)
    return _days(spark, d).join(F.broadcast(h), F.col("d") == F.col("holiday"), "right").groupBy("holiday").agg(F.count("o_orderkey").alias("n_orders"))


@query("c5_first_working_day", f"WITH {_HOLIDAYS} SELECT o_orderkey, f AS first_working_day FROM orders JOIN (SELECT date_trunc('month', d) AS m, min(d) AS f FROM w GROUP BY 1) ON m = date_trunc('month', o_orderdate)")
def _(spark, d):
    first = C.first_working_days(_working(spark)[1])
    return _days(spark, d).join(F.broadcast(first), F.trunc("d", "MM") == F.col("month")).select("o_orderkey", "first_working_day")


@query("c6_next_working_day", f"WITH {_HOLIDAYS} SELECT o_orderkey, w.d AS next_working_day FROM orders ASOF JOIN w ON w.d > CAST(o_orderdate AS DATE)")
def _(spark, d):
    next_day = C.next_working_day(*_working(spark))
    return _days(spark, d).join(F.broadcast(next_day), "d").select("o_orderkey", "next_working_day")


@query("c7_second_after", f"SELECT o_orderkey, CAST({DAY} + CAST((2 - dayofweek({DAY}) + 6) % 7 + 1 + 7 AS INTEGER) AS DATE) AS minutes_day FROM orders")
def _(spark, d):
    return _days(spark, d).select("o_orderkey", C.second_after(F.col("d"), "TUE").alias("minutes_day"))


@query("c8_period_rule", f"""SELECT o_orderkey, CASE WHEN month({DAY}) = 12 THEN {_nth(_month(DAY, 1), 4, 4)} WHEN year({_month(DAY, 1)}) < 2016 THEN {_nth(_month(DAY, 1), 4, 2)} ELSE {_nth(_month(DAY, 1), 4, 3)} END AS published FROM orders""")
def _(spark, d):
    return _days(spark, d).select("o_orderkey", C.labour_release(F.col("d")).alias("published"))


@query("c9_rule_by_series", f"""WITH {_HOLIDAYS.replace('1992', '2020').replace('2003', '2031').replace('2002', '2030').replace('(12, 25)', '(12, 25), (6, 19)').replace('AS d FROM fixed', 'AS d FROM fixed WHERE NOT (month(d) = 6 AND year(d) < 2021)')}, {EVENTS}
    SELECT entity, series_id, observation_date, value, CASE series_id WHEN 'click' THEN observation_date WHEN 'view' THEN (SELECT min(d) FROM w WHERE d > observation_date) ELSE observation_date + 20 END AS publication_date FROM l""")  # fmt: skip
def _(spark, d):
    calendar = C.days(spark, "2020-01-01", "2030-12-31")
    working = C.working_days(calendar, C.us_federal_holidays(spark, 2020, 2030))
    rules = spark.createDataFrame([("click", "same_day"), ("view", "next_working_day"), *((x, "flat_days") for x in ("error", "purchase", "signup"))], "series_id string, rule string")
    return C.published_by_rule(events(spark, d).drop("publication_date"), rules, F.broadcast(C.next_working_day(calendar, working)))


@query("c10_overrides", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_orderdate AS DATE) + 3 END, CAST(o_orderdate AS DATE) + 30) AS published FROM orders""")
def _(spark, d):
    days = _days(spark, d)
    return C.with_overrides(days.select("o_orderkey", F.date_add("d", 30).alias("published")), days.filter("o_orderkey % 10 = 0").select("o_orderkey", F.date_add("d", 3).alias("published")), "o_orderkey", "published")


@query("c12_attach_publication", f"""WITH {EVENTS}, k AS (SELECT DISTINCT observation_date, observation_date + 5 AS p FROM l WHERE day(observation_date) <= 20)
    SELECT entity, series_id, observation_date, value, coalesce(p, observation_date + 40) AS publication_date FROM l LEFT JOIN k USING (observation_date)""")  # fmt: skip
def _(spark, d):
    obs = events(spark, d).drop("publication_date")
    calendar = obs.select("observation_date").distinct().filter(F.day("observation_date") <= 20).withColumn("publication_date", F.date_add("observation_date", 5))
    return C.attach_publication(obs, calendar, 40)


@query("c13_schedule", """WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT d, 1 AS is_past FROM x WHERE d <= DATE '1998-01-01'
    UNION ALL SELECT * FROM (SELECT d, 0 FROM x WHERE d > DATE '1998-01-01' ORDER BY d LIMIT 8)""")  # fmt: skip
def _(spark, d):
    return C.schedule(_days(spark, d), "1998-01-01", 8)


@query("c14_schedule_reconciled", """WITH s AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus <> 'F'), a AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)
    SELECT d, 'missing' AS finding FROM (SELECT DISTINCT d FROM a) WHERE d NOT IN (SELECT d FROM s) UNION ALL SELECT d, 'extra' FROM (SELECT DISTINCT d FROM s) WHERE d NOT IN (SELECT d FROM a)
    UNION ALL SELECT d, 'duplicate' FROM s GROUP BY d HAVING count(*) > 1""")  # fmt: skip
def _(spark, d):
    actual = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    return quality.reconciled(actual, _days(spark, d).filter("o_orderstatus <> 'F'").select("d"), "d")


@query("d9_month_match", f"""WITH s AS (SELECT date_trunc('month', l_shipdate) AS m, min(CAST(l_shipdate AS DATE)) AS f, max(CAST(l_shipdate AS DATE)) AS t FROM lineitem GROUP BY 1), r AS (SELECT m, count(DISTINCT d) AS n, min(d) AS f FROM (SELECT m, f AS d FROM s UNION ALL SELECT m, t FROM s WHERE month(m) % 2 = 1) GROUP BY 1)
    SELECT o_orderkey, coalesce(n, 0) AS n_matches, CASE WHEN n = 1 THEN f END AS matched_day FROM orders LEFT JOIN r ON m = date_trunc('month', o_orderdate)""")  # fmt: skip
def _(spark, d):
    ship = F.to_date("l_shipdate")
    ends = table(spark, d, "lineitem").groupBy(F.trunc(ship, "MM").alias("m")).agg(F.min(ship).alias("f"), F.max(ship).alias("t"))
    right = ends.select(F.explode(F.when(F.month("m") % 2 == 1, F.array_distinct(F.array("f", "t"))).otherwise(F.array("f"))).alias("s"))
    return quality.matched_by_month(_days(spark, d), right, "d", "s", "o_orderkey")
