"""Order in tables of any size: rows in written ranges of their keys and values, with counts a range, so that no task holds a whole key's rows.

Ranks, quantiles and counts below a point all come from the same two facts: how many rows stand in earlier ranges, and where a row stands in its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.sources.sinks import written

#: Rows of a range, about; and the largest table of a few numbers a range that is broadcast.
RANGE_ROWS, MOST_BROADCAST = 500_000, 200_000


def broadcast_if_small(table: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has at most so many; else joins shuffle it."""
    return F.broadcast(table) if table.count() <= most else table


def in_ranges(df: DataFrame, keys: list[str], order: list[str], most_rows: int | None = None, rows_a_range: int | None = None) -> DataFrame:
    """df with range, written: rows are dealt by keys and order into ranges of about so many rows. Rows with equal keys and order share a range.

    most_rows: a bound of df's rows that is known already; without one, or if it is far above a few ranges, df is written first and counted.
    """
    rows_a_range = rows_a_range or RANGE_ROWS
    if most_rows is None or most_rows > 16 * rows_a_range:
        df = written(df, "unranged")
        most_rows = df.count()
    n = max(1, -(-most_rows // rows_a_range))
    return written(df.repartitionByRange(n, *keys, *order).withColumn("range", F.spark_partition_id()), "ranges")


def range_offsets(ranges: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """keys, range, and for each name the sum over earlier ranges of the same keys, and <name>_own over its own: one row a range and key."""
    per = ranges.groupBy(*keys, "range").agg(*[c.alias(f"{x}_own") for x, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return written(per.select("*", *[F.coalesce(F.sum(f"{x}_own").over(before), F.lit(0)).alias(x) for x in sums]), "offsets")


def mid_ranks(counts: DataFrame, keys: list[str], value: str, n: str = "n", most_rows: int | None = None) -> DataFrame:
    """counts (keys, value, n) with rank: the mean rank, from 1, of a value among all of its keys. most_rows: see :func:`in_ranges`."""
    ranges = in_ranges(counts, keys, [value], most_rows)
    offsets = range_offsets(ranges, keys, {"_before": F.sum(n)}).drop("_before_own")
    within = F.sum(n).over(Window.partitionBy(*keys, "range").orderBy(value)) - F.col(n)
    rows = ranges.withColumn("_within", within).join(broadcast_if_small(offsets), [*keys, "range"])
    return rows.withColumn("rank", F.col("_before") + F.col("_within") + (F.col(n) + 1) / 2).drop("range", "_before", "_within")


def long_values(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, feature, v): the values of columns that are known."""
    return df.select(*by, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot(by, columns, "feature", "v").filter("v is not null")


def quantiles(df: DataFrame, columns: list[str], shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, feature, share, value): exact quantiles of columns, interpolated between neighbours, by group. Columns without values have no rows.

    Values are counted, dealt into ranges, and the ranges that hold the wanted places are found from their counts; only those are read again. by holds no nulls.
    """
    by = by or []
    keys = [*by, "feature"]
    counts = long_values(df, columns, by).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    ranges = in_ranges(counts, keys, ["v"])
    offsets = range_offsets(ranges, keys, {"before": F.sum("n")})
    place = F.col("share") * (F.max(F.col("before") + F.col("before_own")).over(Window.partitionBy(*keys)) - 1)
    wanted = offsets.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("place", place)
    wanted = wanted.withColumn("at", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place"))))).filter("at >= before and at < before + before_own")
    wanted = written(wanted, "wanted")
    some = ranges.join(broadcast_if_small(wanted.select(*keys, "range").distinct()), [*keys, "range"], "left_semi")
    within = F.sum("n").over(Window.partitionBy(*keys, "range").orderBy("v"))
    found = some.withColumn("upto", within).join(broadcast_if_small(wanted.select(*keys, "range", "before", "share", "place", "at")), [*keys, "range"])
    found = found.filter((F.col("at") - F.col("before") >= F.col("upto") - F.col("n")) & (F.col("at") - F.col("before") < F.col("upto")))
    ends = found.groupBy(*keys, "share").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.first("place").alias("place"))
    return ends.select(*keys, "share", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))).alias("value"))
