"""Release calendars: rules from period ends to publication days, as date arithmetic and small dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def nth_weekday(d: Column, day: str, n: int) -> Column:
    """The n-th such weekday of d's month; n from 1 to 4, of which every month has one."""
    if not 1 <= n <= 4:
        raise ValueError("n must be from 1 to 4")
    return F.date_add(F.next_day(F.date_sub(F.trunc(d, "MM"), 1), day), 7 * (n - 1))


def last_weekday(d: Column, day: str) -> Column:
    """The last such weekday of d's month."""
    return F.next_day(F.date_sub(F.last_day(d), 7), day)


def last_working_day(d: Column) -> Column:
    """The last Monday-to-Friday day of d's month."""
    end = F.last_day(d)
    return F.date_sub(end, F.when(F.dayofweek(end) == 7, 1).when(F.dayofweek(end) == 1, 2).otherwise(0))


def second_after(d: Column, day: str) -> Column:
    """The second such weekday strictly after d."""
    return F.date_add(F.next_day(d, day), 7)


def working_day_before(d: Column) -> Column:
    """The last Monday-to-Friday day before d."""
    return F.date_sub(d, F.when(F.dayofweek(d) == 2, 3).when(F.dayofweek(d) == 1, 2).otherwise(1))


def days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(d): every day of a range."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("d"))


def easter(year: Column) -> Column:
    """Easter Sunday by the Gregorian computus."""

    def div(a, b):
        return F.floor(a / F.lit(b)).cast("int")

    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * k, 451)
    n = h + k - 7 * m + 114
    return F.make_date(year, div(n, 31), n % 31 + 1)


def us_federal_holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(holiday): observed federal holidays of the United States; Saturdays move to Friday, Sundays to Monday."""
    y = F.col("year")

    def on(month: int, day: int) -> Column:
        d = F.make_date(y, F.lit(month), F.lit(day))
        return F.when(F.dayofweek(d) == 7, F.date_sub(d, 1)).when(F.dayofweek(d) == 1, F.date_add(d, 1)).otherwise(d)

    def nth(month: int, day: str, n: int) -> Column:
        return nth_weekday(F.make_date(y, F.lit(month), F.lit(1)), day, n)

    fixed = [on(1, 1), on(7, 4), on(11, 11), on(12, 25), F.when(y >= 2021, on(6, 19))]
    moving = [nth(1, "MON", 3), nth(2, "MON", 3), last_weekday(F.make_date(y, F.lit(5), F.lit(1)), "MON"), nth(9, "MON", 1), nth(10, "MON", 2), nth(11, "THU", 4)]
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return years.select(F.explode(F.array(*fixed, *moving)).alias("holiday")).filter("holiday is not null")


def australian_holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(holiday): national and New South Wales holidays of Australia; of those on a fixed day all but 25 April move from a weekend to Monday."""
    y = F.col("year")

    def on(month: int, day: int) -> Column:
        d = F.make_date(y, F.lit(month), F.lit(day))
        return F.when(F.dayofweek(d) == 7, F.date_add(d, 2)).when(F.dayofweek(d) == 1, F.date_add(d, 1)).otherwise(d)

    moving = [F.date_sub(easter(y), 2), F.date_add(easter(y), 1), nth_weekday(F.make_date(y, F.lit(6), F.lit(1)), "MON", 2), nth_weekday(F.make_date(y, F.lit(10), F.lit(1)), "MON", 1)]
    every = [on(1, 1), on(1, 26), F.make_date(y, F.lit(4), F.lit(25)), on(12, 25), on(12, 26), *moving]
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return years.select(F.explode(F.array(*every)).alias("holiday")).distinct()


def working_days(calendar: DataFrame, holidays: DataFrame) -> DataFrame:
    """The days of a calendar that are Monday to Friday and no holidays."""
    return calendar.filter(~F.dayofweek("d").isin(1, 7)).join(F.broadcast(holidays.select(F.col("holiday").alias("d"))), "d", "left_anti")


def first_working_days(working: DataFrame) -> DataFrame:
    """(month, first_working_day)."""
    return working.groupBy(F.trunc("d", "MM").alias("month")).agg(F.min("d").alias("first_working_day"))


def next_working_day(calendar: DataFrame, working: DataFrame) -> DataFrame:
    """(d, next_working_day) of every day of a calendar, strictly after it. A calendar is a dimension of some thousand rows."""
    marked = calendar.join(working.withColumn("w", F.col("d")), "d", "left")
    return marked.select("d", F.min("w").over(Window.orderBy("d").rowsBetween(1, Window.unboundedFollowing)).alias("next_working_day"))


def labour_release(period_end: Column) -> Column:
    """A monthly release: in the month after, on its third Thursday, the second one before 2016, the fourth for December's."""
    after = F.add_months(F.trunc(period_end, "MM"), 1)
    return F.when(F.month(period_end) == 12, nth_weekday(after, "THU", 4)).when(F.year(after) < 2016, nth_weekday(after, "THU", 2)).otherwise(nth_weekday(after, "THU", 3))


def published_by_rule(obs: DataFrame, rules: DataFrame, calendar: DataFrame, flat_days: int = 20) -> DataFrame:
    """obs with publication_date by its series' rule: same_day, next_working_day or flat_days. A series without a rule, or with one that isn't known, is an error; so is a day beyond the calendar where the rule needs it."""
    joined = obs.join(F.broadcast(rules), "series_id", "left").join(calendar.select(F.col("d").alias("observation_date"), "next_working_day"), "observation_date", "left")
    day = F.when(F.col("rule") == "same_day", F.col("observation_date")).when(F.col("rule") == "next_working_day", F.col("next_working_day")).when(F.col("rule") == "flat_days", F.date_add("observation_date", flat_days))
    unknown = F.raise_error(F.concat(F.lit("no publication rule for series "), F.coalesce(F.col("series_id").cast("string"), F.lit("null")))).cast("date")
    return joined.select(*obs.columns, F.coalesce(day, unknown).alias("publication_date"))


def attach_publication(obs: DataFrame, calendar: DataFrame, fallback_days: int | None, floor=None, fill_before_floor: bool = True) -> DataFrame:
    """obs with publication_date from a calendar (observation_date, publication_date); where that has none, so many days later.

    floor: observations before it are filled only if fill_before_floor, and from it on only if not. Those that are neither in the calendar nor
    filled are an error. A day that the calendar has several times gets its first publication.
    """
    first = calendar.groupBy("observation_date").agg(F.min("publication_date").alias("publication_date"))
    joined = obs.join(first, "observation_date", "left")
    lost = F.raise_error(F.concat(F.lit("no publication for "), F.coalesce(F.col("observation_date").cast("string"), F.lit("a null day")))).cast("date")
    if fallback_days is None:
        return joined.withColumn("publication_date", F.coalesce("publication_date", lost))
    fill = F.date_add("observation_date", fallback_days)
    if floor is not None:
        before = F.col("observation_date") < F.lit(floor).cast("date")
        fill = F.when(before if fill_before_floor else ~before, fill)
    return joined.withColumn("publication_date", F.coalesce("publication_date", fill, lost))


def with_overrides(calendar: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """calendar with overrides' values where they have the key, and their further rows."""
    both = calendar.select(key, F.col(value).alias("_rule")).join(overrides.select(key, F.col(value).alias("_over")), key, "full")
    return both.select(key, F.coalesce("_over", "_rule").alias(value))


def published_by_rule_table(obs: DataFrame, rules: DataFrame) -> DataFrame:
    """obs with publication_date by a small table of rules (series_id, priority, since, until, month, months_after, weekday, nth).

    A rule holds for periods that end from since to before until (null: open) and, if month is given, in that month of the year; of those that hold, the one with the lowest priority number
    counts. It names the nth weekday (-1: the last) of the month so many months after the period's. An observation without a rule is an error.
    """
    own = rules.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("priority", "since", "until", "month", "months_after", "weekday", "nth"))).alias("_rules"))  # a few a series
    d = F.col("observation_date")
    holds = lambda r: (r["since"].isNull() | (d >= r["since"])) & (r["until"].isNull() | (d < r["until"])) & (r["month"].isNull() | (F.month(d) == r["month"]))
    rows = obs.join(F.broadcast(own), "series_id", "left").withColumn("_rule", F.get(F.filter("_rules", holds), F.lit(0)))
    rows = rows.withColumn("_month", F.add_months(F.trunc(d, "MM"), F.col("_rule.months_after")))
    first = F.expr("next_day(date_sub(_month, 1), _rule.weekday)")
    day = F.when(F.col("_rule.nth") > 0, F.date_add(first, 7 * (F.col("_rule.nth") - 1))).otherwise(F.expr("next_day(date_sub(last_day(_month), 7), _rule.weekday)"))
    lost = F.raise_error(F.concat(F.lit("no rule for "), F.coalesce(F.col("series_id").cast("string"), F.lit("null")), F.lit(" at "), F.coalesce(d.cast("string"), F.lit("a null day")))).cast("date")
    return rows.select(*obs.columns, F.when(F.col("_rule").isNull(), lost).otherwise(day).alias("publication_date"))


#: Steps of a calendar: the period that a day belongs to, and the interval between periods.
STEPS = {"month": ("MM", "interval 1 month"), "quarter": ("quarter", "interval 3 months"), "week": ("week", "interval 7 days")}


def spine(df: DataFrame, day: str, step: str) -> DataFrame:
    """(d) of all periods from the first to the last day of df: the first day of every month, quarter or week, or every weekday (Monday to Friday). No days, no rows."""
    ends = df.agg(F.min(day).cast("date").alias("lo"), F.max(day).cast("date").alias("hi")).filter("lo is not null")  # one row
    if step == "weekday":
        return ends.select(F.explode(F.sequence("lo", "hi")).alias("d")).filter(F.weekday("d") < 5)
    part, by = STEPS[step]
    return ends.select(F.explode(F.sequence(F.trunc("lo", part), F.trunc("hi", part), F.expr(by))).alias("d"))


def moved(dates: DataFrame, overrides: DataFrame) -> DataFrame:
    """(d): dates with those that a small table (d, moved_to) names put elsewhere; duplicates once."""
    own = overrides.groupBy("d").agg(F.max("moved_to").alias("moved_to"))
    return dates.select("d").join(F.broadcast(own), "d", "left").select(F.coalesce("moved_to", "d").alias("d")).distinct()


def next_after(dates: DataFrame, cutoff, by: list[str] | None = None) -> DataFrame:
    """(by, next_day): the first date strictly after a day, by group; without groups, none is an error."""
    rows = dates.filter(F.col("d") > F.lit(cutoff).cast("date"))
    if by:
        return rows.groupBy(*by).agg(F.min("d").alias("next_day"))
    lost = F.raise_error(F.lit(f"no date after {cutoff}")).cast("date")
    return rows.agg(F.coalesce(F.min("d"), lost).alias("next_day"))


def schedule(dates: DataFrame, cutoff, upcoming: int, overrides: DataFrame | None = None) -> DataFrame:
    """(d, is_past) of past dates and the next so many, sorted; duplicates once. overrides: see :func:`moved`."""
    rows = moved(dates, overrides) if overrides is not None else dates.select("d").distinct()
    cut = F.lit(cutoff).cast("date")
    past = rows.filter(F.col("d") <= cut).withColumn("is_past", F.lit(1))
    return past.unionByName(rows.filter(F.col("d") > cut).orderBy("d").limit(upcoming).withColumn("is_past", F.lit(0)))
