"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN as null: the library knows one kind of missing value."""
    return F.when(~F.isnan(c), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def rounded(c: Column, digits: int) -> Column:
    """A double to so many digits, halves away from zero, by its product with their power of ten, as DuckDB rounds; ``F.round`` goes by the double's decimal text instead, so halves differ."""
    return F.round(c * float(10**digits), 0) / float(10**digits)


def signed_number(c: Column) -> Column:
    """Signed text as a double: Unicode minus allowed, a plus dropped; null for ranges ("x to y") and what isn't a number."""
    plain = F.translate(F.trim(c), "−+", "-")
    return F.when(~F.contains(c, F.lit("to")), plain.try_cast("double"))


def label_of_sign(c: Column, down: str = "cut", flat: str = "hold", up: str = "hike") -> Column:
    """The label of a change's sign; null for null."""
    return F.when(c < 0, down).when(c > 0, up).when(c == 0, flat)


def mapped(c: Column, labels: dict) -> Column:
    """Values by a small dictionary; null for others."""
    pairs = [x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), c)


def month_end(d: Column) -> Column:
    """The last day of d's month."""
    return F.last_day(d)


def quarter_end(d: Column) -> Column:
    """The last day of d's quarter."""
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def period_end(text: Column) -> Column:
    """The last day of a period written YYYY-Qn or YYYY-MM; null for other text."""
    year, quarter, month = (F.nullif(F.regexp_extract(text, r"^(\d{4})-(?:Q([1-4])|(0[1-9]|1[0-2]))$", i), F.lit("")).cast("int") for i in (1, 2, 3))
    return F.last_day(F.make_date(year, F.coalesce(quarter * 3, month), F.lit(1)))


def era(d: Column, start, end) -> Column:
    """1 within [start, end), either of which may be open (None), else 0."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (d >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (d < F.lit(end).cast("date"))
    return inside.cast("int")


def window(d: Column, start, end) -> Column:
    """1 within [start, end], both days included, else 0."""
    return d.between(F.lit(start).cast("date"), F.lit(end).cast("date")).cast("int")


def regimes(d: Column, eras: dict[str, tuple], windows: dict[str, tuple], since: dict[str, object]) -> list[Column]:
    """regime_<name> flags: eras are half-open and may be open-ended, windows include both ends, and since (a change of cadence) holds from a day on. Null days have no flag set."""
    own = {k: era(d, *v) for k, v in eras.items()} | {k: window(d, *v) for k, v in windows.items()} | {k: era(d, v, None) for k, v in since.items()}
    return [F.coalesce(c, F.lit(0)).alias(f"regime_{k}") for k, c in own.items()]


def regimes_by_table(df: DataFrame, day: str, table: DataFrame, names: list[str]) -> DataFrame:
    """df with regime_<name> by a small table (name, since, until, closed): since and until may be null (open); until is included where closed is true. A regime may have several rows."""
    spans = table.filter(F.col("name").isin(names)).agg(F.collect_list(F.struct("name", "since", "until", "closed")).alias("_spans"))  # one row
    d = F.col(day)
    open_ = lambda r: (r["since"].isNull() | (d >= r["since"])) & (r["until"].isNull() | (d < r["until"]) | (r["closed"] & (d == r["until"])))
    flags = [F.exists(F.filter("_spans", lambda r: r["name"] == name), lambda r: F.coalesce(open_(r), F.lit(False))).cast("int").alias(f"regime_{name}") for name in names]
    return df.crossJoin(F.broadcast(spans)).select(*df.columns, *flags)


def shifted(d: Column, cutover, before: int = 0, after: int = -1) -> Column:
    """A day moved by so many days: one number before a cutover, another from it on."""
    return F.when(d < F.lit(cutover).cast("date"), F.date_add(d, before)).otherwise(F.date_add(d, after))
