"""Decision tables, targets and which columns may be features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.scalars import label_of_sign, signed_number
from tidegauge.operators.features import Panel


def decisions(raw: DataFrame, history_start) -> DataFrame:
    """(entity, observation_date, [publication_date,] change_bps, new_rate, prior_rate) of raw text rows since history_start; what can't be parsed is dropped.

    Rows with a publication date are held to :func:`decision_rules`: one that breaks them ends the job.
    """
    known = ["publication_date"] if "publication_date" in raw.columns else []
    change, new = signed_number(F.col("change_raw")), signed_number(F.col("new_rate_raw"))
    rows = raw.filter(F.col("observation_date") >= F.lit(history_start).cast("date")).select("entity", "observation_date", *known, change.alias("change"), new.alias("new_rate")).dropna(subset=["observation_date", "change", "new_rate"])
    out = rows.select("entity", "observation_date", *known, F.bround(F.col("change") * 100, 0).cast("int").alias("change_bps"), "new_rate", (F.col("new_rate") - F.col("change")).alias("prior_rate"))
    return checked(out, decision_rules()) if known else out


def target(df: DataFrame, rule: str, column: str, bins: list[int] | None = None, labels: dict | None = None) -> DataFrame:
    """df with label by a rule (sign_of_change, discrete_bps or identity) of a column; rows without one are dropped. Unknown rules and columns raise."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    rules: dict[str, Column] = {"sign_of_change": label_of_sign(F.col(column)), "discrete_bps": F.when(F.col(column).isin(bins or []), F.col(column).cast("int")), "identity": F.col(column).try_cast("double")}
    if rule not in rules:
        raise ValueError(f"no rule {rule}")
    label = rules[rule]
    if labels:
        label = F.try_element_at(F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]), label)
    return df.withColumn("label", label).filter(F.col("label").isNotNull())


def feature_columns(df: DataFrame, meta: list[str], outcomes: list[str]) -> list[str]:
    """Numeric columns that are neither about the row nor what is to be predicted; lags of outcomes stay."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in {*meta, *outcomes}]


def without_collisions(df: DataFrame, new: list[Column], names: list[str]) -> DataFrame:
    """df with new columns in one projection; a name that is there already raises."""
    if clash := set(names) & set(df.columns) or {x for x in names if names.count(x) > 1}:
        raise ValueError(f"columns twice: {sorted(clash)}")
    return df.select("*", *[c.alias(n) for c, n in zip(new, names, strict=True)])


def event_spine(df: DataFrame, p: Panel, day: str, level: str, since, absent: tuple[str, ...] = ()) -> DataFrame:
    """df's events from a day on with prior_value and gap_days, both of the event before, also where that lies before the day; absent: columns that are added as null text where df lacks them."""
    prior, gap = F.lag(level).over(p.window), F.date_diff(day, F.lag(day).over(p.window))
    more = [F.lit(None).cast("string").alias(c) for c in absent if c not in df.columns]
    return df.select("*", prior.alias("prior_value"), gap.alias("gap_days"), *more).filter(F.col(day) >= F.lit(since).cast("date"))


def decision_rules() -> dict[str, Column]:
    """What must hold of each row of a decision table, by what is wrong where it doesn't; for ``quality.failures`` and :func:`checked`."""
    known = {f"{c} is null": F.col(c).isNotNull() for c in ("observation_date", "publication_date", "new_rate", "change_bps")}
    return known | {"published after observation": F.col("publication_date") <= F.col("observation_date"), "rates do not add up": F.abs(F.col("prior_rate") + F.col("change_bps") / 100 - F.col("new_rate")) < 1e-6}


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df; a row for which a rule doesn't hold, or isn't known, ends the job with what is wrong."""
    wrong = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    ok = F.when(F.size(wrong) > 0, F.raise_error(F.array_join(wrong, "; "))).cast("string")
    return df.withColumn("_ok", ok).filter("_ok is null").select(*df.columns)
