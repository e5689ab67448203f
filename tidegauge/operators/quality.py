"""Reconciliation, invariants, inventories and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failures(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """(rule, n_failed, first_key): one pass over df for all rules; a rule holds where its column is true, null counts as failed."""
    reasons = F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()])))
    return df.select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), reasons.alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_failed"), F.min("key").alias("first_key"))


def reconciled(expected: DataFrame, actual: DataFrame, key: str, allowed: DataFrame | None = None) -> DataFrame:
    """(key, finding): missing (expected but neither actual nor allowed), extra (actual only) and duplicate keys."""
    missing = expected.select(key).distinct().join(actual.select(key), key, "left_anti")
    if allowed is not None:
        missing = missing.join(allowed.select(key), key, "left_anti")
    extra = actual.select(key).distinct().join(expected.select(key), key, "left_anti")
    twice = actual.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)
    return missing.withColumn("finding", F.lit("missing")).unionByName(extra.withColumn("finding", F.lit("extra"))).unionByName(twice.withColumn("finding", F.lit("duplicate")))


def matched_by_month(left: DataFrame, right: DataFrame, day_left: str, day_right: str, key: str) -> DataFrame:
    """left's keys with the number of right's rows in the same month, and that row's day if there is exactly one."""
    per = right.groupBy(F.trunc(day_right, "MM").alias("_m")).agg(F.count(F.lit(1)).alias("n_matches"), F.min(day_right).alias("_d"))
    joined = left.join(per, F.trunc(day_left, "MM") == F.col("_m"), "left")
    return joined.select(key, F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"), F.when(F.col("n_matches") == 1, F.col("_d")).alias("matched_day"))


def inventory(obs: DataFrame, registry: DataFrame) -> DataFrame:
    """registry (source, series_id) with number of observations and last observation; those without any have 0 and null."""
    per = obs.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_observations"), F.max("observation_date").alias("last_observation"))
    return registry.join(per, "series_id", "left").select("source", "series_id", F.coalesce("n_observations", F.lit(0).cast("long")).alias("n_observations"), "last_observation")


def staleness(df: DataFrame, ages: list[str]) -> list[Column]:
    """n_missing, median_age and max_age over a row's age columns."""
    known = F.array_sort(F.array_compact(F.array(*ages)))
    n = F.size(known)
    middle = (F.get(known, F.floor((n - 1) / 2).cast("int")) + F.get(known, F.floor(n / 2).cast("int"))) / 2
    return [(F.lit(len(ages)) - n).alias("n_missing"), F.when(n > 0, middle).alias("median_age"), F.array_max(known).alias("max_age")]


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, n_null, n) of every column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c) for c in df.columns])
    return counts.unpivot("_n", df.columns, "column_name", "n_null").select("column_name", F.coalesce("n_null", F.lit(0).cast("long")).alias("n_null"), F.col("_n").alias("n"))


def manifest(df: DataFrame, day: str) -> DataFrame:
    """One row: n_rows, n_columns, first and last day, and a hash of the content that doesn't depend on order."""
    content = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), content.cast("string").alias("content_hash"))


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order: splices (live over archive), priorities (page over archive over inferred), latest snapshots."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def by_priority(sources: dict[str, DataFrame], keys: list[str], then: list) -> DataFrame:
    """One row a key, with its source: from the first source, in the order given, that has it; of several there the first by ``then``."""
    every = None
    for i, (name, df) in enumerate(sources.items()):
        own = df.withColumns({"source": F.lit(name), "_priority": F.lit(i)})
        every = own if every is None else every.unionByName(own)
    return newest(every, keys, [F.col("_priority"), *then]).drop("_priority")


def only_in_first(first: DataFrame, second: DataFrame) -> DataFrame:
    """The distinct rows of the first that aren't in the second."""
    return first.subtract(second)


def in_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """df sorted by its keys, rows that tie in the order they are read: a sort over ranges of the keys, not in one task."""
    return df.withColumn("_at", F.monotonically_increasing_id()).orderBy(*keys, "_at").drop("_at")


def latest_snapshot(df: DataFrame, by: list[str], snapshot: str) -> DataFrame:
    """The rows of each group's latest snapshot, all of them; rows without a snapshot, and groups without any, are left out. Only one row a group is shuffled against them."""
    last = df.filter(F.col(snapshot).isNotNull()).groupBy(*by).agg(F.max(snapshot).alias(snapshot))
    return df.join(last, [*by, snapshot], "left_semi")


def union_of(frames: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """All rows of frames with the same columns, in any order, with the name of their frame; other columns, or fewer, are an error."""
    out, columns = None, None
    for name, df in frames.items():
        if columns is not None and set(df.columns) != columns:
            raise ValueError(f"{name} has columns {sorted(df.columns)}, not {sorted(columns)}")
        columns = set(df.columns)
        own = df.withColumn(source, F.lit(name))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no frames")
    return out


def absent(registry: DataFrame, actual: DataFrame, on: dict[str, str]) -> DataFrame:
    """The rows of registry without a row of actual; on: registry's columns by actual's. Null keys of registry are absent."""
    keys = actual.select(*[F.col(theirs).alias(own) for own, theirs in on.items()])
    return registry.join(keys, list(on), "left_anti")
