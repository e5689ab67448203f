"""As-of joins of long observations onto an event spine, as one union, one sort and one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG = ("series_id", "observation_date", "publication_date", "value")


def check_long(obs: DataFrame) -> DataFrame:
    """obs, if it has the columns of the long contract; an error names those that are missing."""
    if missing := [c for c in LONG if c not in obs.columns]:
        raise ValueError(f"long observations lack {missing}")
    return obs


#: Types of the long contract.
TYPES = {"series_id": "string", "observation_date": "date", "publication_date": "date", "value": "double"}


def conform(df: DataFrame) -> DataFrame:
    """df in the long contract: its columns first, in their order and cast to their types, then any others.

    Columns that are missing are an error, and so is a value that its type can't hold. Rows without a series, day or value are left out; a null
    publication date means not published yet.
    """
    check_long(df)

    def strict(name: str) -> Column:
        own = F.col(name).try_cast(TYPES[name])
        bad = F.raise_error(F.concat(F.lit(f"{name} can't hold "), F.col(name).cast("string"))).cast(TYPES[name])
        return F.when(F.col(name).isNull() | own.isNotNull(), own).otherwise(bad)

    rows = df.select(*[strict(c).alias(c) for c in TYPES], *[F.col(f"`{c}`") for c in df.columns if c not in TYPES])
    return rows.filter("series_id is not null and observation_date is not null and value is not null")


def as_of(spine: DataFrame, obs: DataFrame, keys: list[str], at: str = "event_date", strict: bool = True, within_days: int | None = None, bucket_days: int | None = None) -> DataFrame:
    """spine (keys and at) with value, age_days and is_missing of the latest observation published before each event.

    Strict: publication before the event; else on its day too. Unpublished observations (null publication date) never join. The latest row counts even if its
    value is null: then the value is null, the age is not, and the flag is 1. Of rows published on one day the latest observed counts, then the
    largest value. within_days leaves older ones out. keys hold the series too, if obs has several.

    bucket_days divides a key's history by time, for keys too large for one task: each bucket is searched by itself, and what
    came last before it is carried in from a window over one row a bucket.
    """
    side = 0 if strict else 1
    seen = F.struct(F.col("publication_date").alias("pub"), F.col("value"))
    a = spine.select(*keys, F.col(at).alias("_t"), F.lit(side).alias("_side"), F.lit(None).cast("date").alias("_obs"), F.lit(None).cast("struct<pub:date,value:double>").alias("_seen"), F.lit(None).cast("double").alias("_v"))
    b = check_long(obs).filter("publication_date is not null")
    b = b.select(*keys, F.col("publication_date").alias("_t"), F.lit(1 - side).alias("_side"), F.col("observation_date").alias("_obs"), seen.alias("_seen"), F.col("value").alias("_v"))
    both = a.unionByName(b)
    order = ["_t", "_side", "_obs", "_v"]
    if bucket_days is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        rows = both.withColumn("_last", F.last("_seen", ignorenulls=True).over(w))
    else:
        both = both.withColumn("_b", F.floor(F.unix_date("_t") / bucket_days))
        w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        ends = both.filter("_seen is not null").groupBy(*keys, "_b").agg(F.max_by("_seen", F.struct("_t", "_obs", "_v")).alias("_end"))
        places = both.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "left")
        before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = places.select(*keys, "_b", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
        rows = both.withColumn("_last", F.last("_seen", ignorenulls=True).over(w)).join(carried, [*keys, "_b"]).withColumn("_last", F.coalesce("_last", "_carried"))
    rows = rows.filter(F.col("_side") == side)
    age = F.date_diff("_t", "_last.pub")
    good = F.lit(True) if within_days is None else age <= within_days
    value = F.when(good, F.col("_last.value"))
    return rows.select(*keys, F.col("_t").alias(at), value.alias("value"), F.when(good, age).alias("age_days"), value.isNull().cast("int").alias("is_missing"))


def assemble_wide(spine: DataFrame, obs: DataFrame, entity: list[str], series: list[str], at: str = "event_date") -> DataFrame:
    """One row an event: <series>, <series>_age_days and <series>_is_missing for each of the series named, as :func:`as_of` gives them for one.

    Spine and observations are united and sorted once by entity; one window carries the last observation of each series, so events aren't multiplied by series and
    nothing is pivoted. The series named are a short list.
    """
    kind = "struct<pub:date,value:double>"
    a = spine.select(*entity, F.col(at).alias("_t")).distinct().select(*entity, "_t", F.lit(0).alias("_side"), F.lit(None).cast("date").alias("_obs"), F.lit(None).cast("double").alias("_v"), F.lit(None).cast("string").alias("_s"), F.lit(None).cast(kind).alias("_seen"))
    b = check_long(obs).filter(F.col("publication_date").isNotNull() & F.col("series_id").isin(series))
    b = b.select(*entity, F.col("publication_date").alias("_t"), F.lit(1).alias("_side"), F.col("observation_date").alias("_obs"), F.col("value").cast("double").alias("_v"), F.col("series_id").alias("_s"), F.struct(F.col("publication_date").alias("pub"), F.col("value").cast("double").alias("value")).alias("_seen"))
    w = Window.partitionBy(*entity).orderBy("_t", "_side", "_obs", "_v").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("_s") == s, F.col("_seen")), ignorenulls=True).over(w).alias(f"_last_{i}") for i, s in enumerate(series)]
    rows = a.unionByName(b).select(*entity, "_t", "_side", *last).filter("_side = 0")
    own = [x for i, s in enumerate(series) for x in (F.col(f"_last_{i}.value").alias(s), F.date_diff("_t", f"_last_{i}.pub").alias(f"{s}_age_days"), F.col(f"_last_{i}.value").isNull().cast("int").alias(f"{s}_is_missing"))]
    return rows.select(*entity, F.col("_t").alias(at), *own)


def sources_collide(frames: dict[str, DataFrame]) -> DataFrame:
    """(series_id, n_sources) of series that more than one source gives."""
    every = None
    for name, df in frames.items():
        part = df.select("series_id", F.lit(name).alias("source")).distinct()
        every = part if every is None else every.unionByName(part)
    return every.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_sources")).filter("n_sources > 1")


def lookup_latest(left: DataFrame, right: DataFrame, on: list[str], value: str, order: list[str]) -> DataFrame:
    """left with value of the last row, by order, of right with equal keys; null without one."""
    last = right.groupBy(*on).agg(F.max_by(value, F.struct(*order)).alias(value))
    return left.join(last, on, "left")


def enriched(df: DataFrame, other: DataFrame, on: dict[str, str], columns: list[str]) -> DataFrame:
    """df with columns of the row of other whose keys are equal (on: df's keys by other's), null without one; rows of df are neither lost nor multiplied.

    Several rows of other with one key are an error where df asks for it.
    """
    names = {f"_k{i}": theirs for i, theirs in enumerate(on.values())}
    per = other.select(*[F.col(v).alias(k) for k, v in names.items()], *columns).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in columns])
    joined = df.join(per, [F.col(own) == F.col(k) for own, k in zip(on, names, strict=True)], "left")
    sound = F.when(F.col("_n") > 1, F.raise_error(F.concat_ws(" ", F.lit("several rows for"), *[F.col(c).cast("string") for c in on])))
    return joined.withColumn("_ok", sound.cast("string")).filter("_ok is null").select(*df.columns, *columns)
