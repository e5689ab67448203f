"""Features along keyed panels: every window is divided by entity and ordered by event and tie-break."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.scalars import ratio


@dataclass(frozen=True)
class Panel:
    """Which columns divide and order a panel."""

    entity: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.entity).orderBy(*self.order)

    def last(self, rows: int) -> WindowSpec:
        """The last so many rows with the current one."""
        return self.window.rowsBetween(-(rows - 1), 0)

    @property
    def so_far(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, 0)


def lags(p: Panel, columns: list[str], horizons=(1, 2, 3, 6, 12)) -> list[Column]:
    """<col>_lag_<h>: the value so many events before; null at the start."""
    return [F.lag(c, h).over(p.window).alias(f"{c}_lag_{h}") for c in columns for h in horizons]


def rolling(p: Panel, columns: list[str], windows=(3, 6, 12), stats=("mean", "std", "min", "max", "zscore")) -> list[Column]:
    """<col>_roll_<w>_<stat> over the last w rows; null unless all w values are there. A flat window's z-score is null."""
    out = []
    for c in columns:
        for w in windows:
            over = p.last(w)
            mean, sd = F.avg(c).over(over), F.stddev_samp(c).over(over)
            of = {"mean": mean, "std": sd, "min": F.min(c).over(over), "max": F.max(c).over(over), "zscore": ratio(F.col(c) - mean, sd)}
            out += [F.when(F.count(c).over(over) == w, of[s]).alias(f"{c}_roll_{w}_{s}") for s in stats]
    return out


def changes(p: Panel, columns: list[str], differences=(1, 3, 6, 12), percents=(1, 3, 12)) -> list[Column]:
    """<col>_diff_<h> and <col>_pct_<h>; a zero base gives null."""
    out = [(F.col(c) - F.lag(c, h).over(p.window)).alias(f"{c}_diff_{h}") for c in columns for h in differences]
    return out + [ratio(F.col(c) - F.lag(c, h).over(p.window), F.lag(c, h).over(p.window)).alias(f"{c}_pct_{h}") for c in columns for h in percents]


def value_days_before(p: Panel, column: str, day: str, days: int = 365) -> Column:
    """The value of the latest row at least so many days earlier, null values included."""
    w = Window.partitionBy(*p.entity).orderBy(F.unix_date(day)).rangeBetween(Window.unboundedPreceding, -days)
    return F.last(column).over(w)


def year_on_year(p: Panel, column: str, day: str) -> Column:
    """Change on the value a year before, as a share; a zero base gives null."""
    base = value_days_before(p, column, day)
    return ratio(F.col(column) - base, base)


def ewma(df: DataFrame, p: Panel, column: str, span: int) -> Column | DataFrame:
    """df with <col>_ewma_<span>: the exponentially weighted mean, weights falling by position.

    Rows with null values still age the weights and carry the last mean; before the first value it is null. Weights below 1e-16 are
    left out, which bounds the frame: the cost is linear in rows.
    """
    alpha = 2.0 / (span + 1)
    rows = math.ceil(37 / -math.log1p(-alpha))
    frame = F.collect_list(F.struct(F.col(column).alias("v"))).over(p.last(rows))
    zero = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))

    def step(acc, x):
        has = x["v"].isNotNull()
        return F.struct((acc["num"] * (1 - alpha) + F.when(has, x["v"]).otherwise(0.0)).alias("num"), (acc["den"] * (1 - alpha) + F.when(has, 1.0).otherwise(0.0)).alias("den"))

    mean = F.when(F.col(column).isNotNull(), F.aggregate(frame, zero, step, lambda a: ratio(a["num"], a["den"])))
    name = f"{column}_ewma_{span}"
    return df.withColumn(name, mean).withColumn(name, F.last(name, ignorenulls=True).over(p.so_far))


def forward_filled(p: Panel, column: str, carry: Column | None = None) -> Column:
    """The last value so far; before the first one the carry, or zero."""
    return F.coalesce(F.last(column, ignorenulls=True).over(p.so_far), *([carry] if carry is not None else []), F.lit(0.0))


def cycle_phase(p: Panel, column: str, rows: int = 3, threshold: float = 0.05) -> Column:
    """tightening, easing or on-hold, by the change over so many rows; on-hold where it isn't known."""
    delta = F.col(column) - F.lag(column, rows).over(p.window)
    return F.when(delta > threshold, "tightening").when(delta < -threshold, "easing").otherwise("on-hold")


def trend_gap(p: Panel, column: str, rows: int = 60, least: int = 4) -> Column:
    """How far a value is below its trailing mean; null with too few values."""
    over = p.last(rows)
    return F.when(F.count(column).over(over) >= least, F.avg(column).over(over) - F.col(column))


def since_previous(p: Panel, day: str, value: str) -> list[Column]:
    """Days since the previous event, and its value."""
    return [F.date_diff(day, F.lag(day).over(p.window)).alias("gap_days"), F.lag(value).over(p.window).alias("previous_value")]


def surprises(pairs: dict[str, str]) -> list[Column]:
    """<realised>_surprise: realised less expected."""
    return [(F.col(a) - F.col(b)).alias(f"{a}_surprise") for a, b in pairs.items()]


def missing_flags(df: DataFrame) -> list[Column]:
    """<level>_is_missing of every column that has an <level>_age_days beside it."""
    return [F.col(c).isNull().cast("int").alias(f"{c}_is_missing") for c in df.columns if f"{c}_age_days" in df.columns]


def feature_group(name: Column) -> Column:
    """The group of a feature by its name, first match in this order."""
    return (
        F.when(name.endswith("_is_missing"), "missing_flag").when(name.endswith("_age_days"), "staleness").when(name.startswith("regime_"), "regime").when(name.endswith("_surprise"), "surprise")
        .when(name.contains("_roll_"), "rolling").when(name.contains("_lag_"), "lag").when(name.rlike("_(diff|pct)_\\d+$|_yoy_pct$"), "change").otherwise("level")
    )


def append_future(df: DataFrame, p: Panel, day: str, level: str, future_day) -> DataFrame:
    """df with one more row for each entity at future_day: previous level known, outcomes null. Entities with a row on or after that day get none."""
    last = df.groupBy(*p.entity).agg(F.max_by(F.struct(F.col(day).alias("d"), F.col(level).alias("v")), F.struct(*p.order)).alias("l"))
    rows = last.filter(F.col("l.d") < F.lit(future_day).cast("date"))
    rows = rows.select(*p.entity, F.lit(future_day).cast("date").alias(day), F.col("l.v").alias("previous_value"), F.date_diff(F.lit(future_day).cast("date"), "l.d").alias("gap_days"))
    return df.unionByName(rows, allowMissingColumns=True)


def spliced(old: DataFrame, new: DataFrame, keys: list[str], day: str, value: str, tolerance: float | None = None) -> DataFrame:
    """One index of two: new from its first day on, before that old scaled by new's ratio to old on that day. Keys without a common boundary keep old as it is.

    tolerance: old's growth into the boundary and new's growth out of it may differ by that much; more, or no such growth, is an error.
    """
    start = new.groupBy(*keys).agg(F.min(day).alias("_start"), F.min_by(value, day).alias("_new"))
    edge = old.join(start, keys).filter(F.col(day) == F.col("_start")).select(*keys, ratio(F.col("_new"), F.col(value)).alias("_factor"))
    if tolerance is not None:
        w = Window.partitionBy(*keys).orderBy(day)
        into = old.withColumn("_into", F.col(value) / F.lag(value).over(w) - 1).select(*keys, F.col(day).alias("_start"), "_into")
        out = new.withColumn("_out", F.lead(value).over(w) / F.col(value) - 1).select(*keys, F.col(day).alias("_start"), "_out")
        gaps = start.join(into, [*keys, "_start"]).join(out, [*keys, "_start"]).select(*keys, F.abs(F.col("_out") - F.col("_into")).alias("_gap"))
        wrong = F.raise_error(F.concat(F.lit("growth differs at the splice by "), F.coalesce(F.col("_gap").cast("string"), F.lit("an unknown rate")))).cast("double")
        edge = edge.join(gaps, keys, "left").select(*keys, F.when(F.col("_gap") <= tolerance, F.col("_factor")).otherwise(wrong).alias("_factor"))
    before = old.join(start.select(*keys, "_start"), keys, "left").filter(F.col("_start").isNull() | (F.col(day) < F.col("_start"))).join(edge, keys, "left")
    return before.select(*keys, day, (F.col(value) * F.coalesce("_factor", F.lit(1.0))).alias(value)).unionByName(new.select(*keys, day, value))


def year_on_year_group(p: Panel, columns: list[str], day: str) -> list[Column]:
    """<col>_yoy_pct of each column."""
    return [year_on_year(p, c, day).alias(f"{c}_yoy_pct") for c in columns]


#: Groups of features by name: each gives columns from a panel, the columns to use and its settings.
GROUPS = {"lags": lags, "rolling": rolling, "changes": changes, "year_on_year": year_on_year_group}


def build(df: DataFrame, p: Panel, columns: list[str], config: dict[str, dict | None]) -> DataFrame:
    """df with the features of every group that config names and does not set to None, in config's order, in one projection. Unknown groups and columns raise."""
    if unknown := (set(config) - set(GROUPS)) | (set(columns) - set(df.columns)):
        raise ValueError(f"not known: {sorted(unknown)}")
    new = [c for name, settings in config.items() if settings is not None for c in GROUPS[name](p, columns, **settings)]
    return df.select("*", *new)


#: What names of companions of a level end with, and names of regime flags begin with.
COMPANIONS, REGIME = ("_age_days", "_is_missing"), "regime_"


def eligible(df: DataFrame, columns: list[str], meta: tuple[str, ...] = ()) -> list[str]:
    """Those of the columns that features may be made of: numbers of df that are neither about the row (meta), nor companions of a level, nor regime flags. A warning names the others, which features then leave out."""
    numbers = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    good = [c for c in columns if c in numbers and c not in meta and not c.endswith(COMPANIONS) and not c.startswith(REGIME)]
    if left := [c for c in columns if c not in good]:
        warnings.warn(f"no features of {left}: not there, not numbers, or not levels", stacklevel=2)
    return good


def next_event_rows(df: DataFrame, p: Panel, day: str, level: str, future_day, make: Callable[[Panel], list[Column]]) -> DataFrame:
    """One row an entity at a future day: what :func:`append_future` gives, with the columns that make gives over past and future rows, as for any other row.

    Windows see each entity's past once; nothing of it is collected. For entities too long for one task use ``tiles.Tiled`` on :func:`append_future`.
    """
    return append_future(df, p, day, level, future_day).select("*", *make(p)).filter(F.col(day) == F.lit(future_day).cast("date"))
