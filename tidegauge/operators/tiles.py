"""Features along panels whose entities are too long for one task: windows over tiles of a bounded number of rows.

Rows get their position within their entity from written ranges, so no task sorts a whole entity. A tile is a stretch of positions. Windows that look back some rows
borrow those rows from the tile before (a halo); what looks back without a bound, the last known value or an exponential mean, is carried
from tile to tile by a window over one row a tile. Each gives the same values as the plain function of ``features``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalars import ratio
from tidegauge.operators import features
from tidegauge.operators.features import Panel
from tidegauge.operators.ranges import broadcast_if_small, in_ranges, range_offsets
from tidegauge.sources.sinks import written

POSITION, TILE = "_position", "_tile"


def positioned(df: DataFrame, p: Panel, rows_a_range: int | None = None) -> DataFrame:
    """df with _position, from 0 within each entity by the panel's order; written."""
    ranges = in_ranges(df, [*p.entity], [*p.order], rows_a_range=rows_a_range)
    offsets = range_offsets(ranges, [*p.entity], {"_before": F.count(F.lit(1))}).drop("_before_own")
    place = F.row_number().over(Window.partitionBy(*p.entity, "range").orderBy(*p.order)) - 1
    rows = ranges.withColumn("_place", place).join(broadcast_if_small(offsets), [*p.entity, "range"])
    return written(rows.select(*df.columns, (F.col("_before") + F.col("_place")).alias(POSITION)), "positioned")


@dataclass(frozen=True)
class Tiled:
    """A panel's rows with their positions; features are added one after another, and ``rows`` has them. Entity columns hold no nulls."""

    table: DataFrame
    panel: Panel
    size: int

    @classmethod
    def of(cls, df: DataFrame, p: Panel, size: int = 100_000, rows_a_range: int | None = None) -> Tiled:
        """size: rows of a tile. Rows of one entity should not tie in the panel's order; those that do take either place."""
        return cls(positioned(df, p, rows_a_range), p, size)

    @property
    def rows(self) -> DataFrame:
        return self.table.drop(POSITION)

    def _tiled(self, size: int | None = None) -> DataFrame:
        return self.table.withColumn(TILE, F.floor(F.col(POSITION) / (size or self.size)))

    def _own(self) -> Panel:
        """The panel within tiles."""
        return Panel((*self.panel.entity, TILE), (POSITION,))

    def looking_back(self, make: Callable[[Panel], list[Column]], rows: int) -> Tiled:
        """With columns that look back at most so many rows; make gives them for a panel, as ``lambda p: features.rolling(p, ["value"])``."""
        size = max(self.size, rows)
        tiles = F.when(F.col(POSITION) % size >= size - rows, F.array(TILE, F.col(TILE) + 1)).otherwise(F.array(TILE)) if rows else F.array(TILE)
        lent = self._tiled(size).withColumn("_in", F.explode(tiles)).withColumn("_lent", F.col("_in") > F.col(TILE)).drop(TILE).withColumnRenamed("_in", TILE)
        out = lent.select("*", *make(self._own())).filter("not _lent").drop(TILE, "_lent")
        return replace(self, table=out)

    def lags(self, columns: list[str], horizons=(1, 2, 3, 6, 12)) -> Tiled:
        return self.looking_back(lambda p: features.lags(p, columns, horizons), max(horizons))

    def rolling(self, columns: list[str], windows=(3, 6, 12), stats=("mean", "std", "min", "max", "zscore")) -> Tiled:
        return self.looking_back(lambda p: features.rolling(p, columns, windows, stats), max(windows) - 1)

    def changes(self, columns: list[str], differences=(1, 3, 6, 12), percents=(1, 3, 12)) -> Tiled:
        return self.looking_back(lambda p: features.changes(p, columns, differences, percents), max(*differences, *percents))

    def trend_gap(self, column: str, name: str, rows: int = 60, least: int = 4) -> Tiled:
        return self.looking_back(lambda p: [features.trend_gap(p, column, rows, least).alias(name)], rows - 1)

    def _carried(self, ends: DataFrame, carry: dict[str, Column]) -> DataFrame:
        """One row a tile with what earlier tiles of its entity leave; ends has a row a tile, and carry the columns over it."""
        return broadcast_if_small(written(ends.select(*self.panel.entity, TILE, *[c.alias(x) for x, c in carry.items()]), "carried"))

    def last_known(self, column: str, name: str) -> Tiled:
        """With the last value so far that isn't null; null before the first."""
        rows, own = self._tiled(), self._own()
        ends = rows.groupBy(*own.entity).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(POSITION))).alias("_end"))
        before = Window.partitionBy(*self.panel.entity).orderBy(TILE).rowsBetween(Window.unboundedPreceding, -1)
        carried = self._carried(ends, {"_carried": F.last("_end", ignorenulls=True).over(before)})
        out = rows.withColumn("_own", F.last(column, ignorenulls=True).over(own.so_far)).join(carried, [*own.entity])
        return replace(self, table=out.withColumn(name, F.coalesce("_own", "_carried")).drop("_own", "_carried", TILE))

    def forward_filled(self, column: str, name: str, carry: Column | None = None) -> Tiled:
        """With the last value so far; before the first one the carry, or zero."""
        out = self.last_known(column, name)
        return replace(out, table=out.table.withColumn(name, F.coalesce(name, *([carry] if carry is not None else []), F.lit(0.0))))

    def ewma(self, column: str, span: int) -> Tiled:
        """With <col>_ewma_<span>, the exponentially weighted mean as ``features.ewma`` gives it, in time linear in the rows.

        Within a tile, sums of values over powers of the decay give every row's weighted sum by one running window; tiles are as long as those powers stay far from
        overflow, and the sums that a tile leaves, decayed by the rows since, are carried into the next ones.
        """
        decay = 1 - 2.0 / (span + 1)
        size = min(self.size, max(2, int(200 * math.log(10) / -math.log(decay)))) if decay > 0 else self.size
        reach = 1 + math.ceil(37 / -math.log(decay) / size) if decay > 0 else 1  # tiles before that weigh more than 1e-16
        rows, own = self._tiled(size), self._own()
        at = F.col(POSITION) % size
        known = F.col(column).isNotNull()
        grown = F.pow(F.lit(1 / decay), at) if decay > 0 else F.lit(1.0)
        num = F.sum(F.when(known, F.col(column) * grown).otherwise(0.0)).over(own.so_far) / grown
        den = F.sum(F.when(known, grown).otherwise(0.0)).over(own.so_far) / grown
        if decay == 0:
            num, den = F.col(column), F.lit(1.0)
        rows = written(rows.withColumn("_num", num).withColumn("_den", den), "sums")
        ends = rows.groupBy(*own.entity).agg(*[F.max_by(c, POSITION).alias(c) for c in ("_num", "_den")])
        along = Window.partitionBy(*self.panel.entity).orderBy(TILE)
        left = lambda c: sum((F.coalesce(F.lag(c, k).over(along), F.lit(0.0)) * decay ** (size * (k - 1)) for k in range(1, reach + 1)), F.lit(0.0))
        carried = self._carried(ends, {"_n": left("_num"), "_d": left("_den")})
        fade = F.pow(F.lit(decay), at + 1)
        out = rows.join(carried, [*own.entity])
        mean = F.when(known, ratio(F.col("_num") + fade * F.col("_n"), F.col("_den") + fade * F.col("_d")))
        named = replace(self, table=out.withColumn("_mean", mean).drop("_num", "_den", "_n", "_d", TILE)).last_known("_mean", f"{column}_ewma_{span}")
        return replace(named, table=named.table.drop("_mean"))


def fold_statistics(df: DataFrame, p: Panel, fold_table: DataFrame, values: list[str], labels: dict[str, list] | None = None, size: int = 100_000, rows_a_range: int | None = None) -> DataFrame:
    """entity, fold, is_test, n, and for each value <v>_n, <v>_mean and <v>_var (of the sample), for each label column's values <c>_<value> their number.

    Running sums at the borders of folds are subtracted, so the work grows with rows and folds and not with their product. Folds are those of
    ``baselines.folds``. Sums run within tiles and are carried over them. Means are of known values; nulls are not counted. A part without rows is left out.
    """
    labels = labels or {}
    tiled = Tiled.of(df, p, size, rows_a_range)
    shift = {v: f"_c{i}" for i, v in enumerate(values)}
    centre = df.agg(*[F.avg(v).alias(c) for v, c in shift.items()]) if values else None  # sums of squares stay small about the mean
    rows = tiled._tiled()
    if values:
        rows = rows.crossJoin(F.broadcast(centre))  # one row
    zero = F.lit(0)
    parts = {"n": F.lit(1)}
    for v in values:
        x = F.col(v).cast("double") - F.col(shift[v])
        parts |= {f"{v}_n": F.when(F.col(v).isNotNull(), 1).otherwise(0), f"{v}_s": F.coalesce(x, F.lit(0.0)), f"{v}_q": F.coalesce(x * x, F.lit(0.0))}
    for c, every in labels.items():
        parts |= {f"{c}_{x}": F.when(F.col(c) == x, 1).otherwise(0) for x in every}
    own = tiled._own()
    running = written(rows.select(*p.entity, TILE, POSITION, *[F.sum(c).over(own.so_far).alias(x) for x, c in parts.items()]), "running")
    ends = running.groupBy(*own.entity).agg(F.max_by(F.struct(*parts), POSITION).alias("_e"))
    before = Window.partitionBy(*p.entity).orderBy(TILE).rowsBetween(Window.unboundedPreceding, -1)
    carried = tiled._carried(ends, {f"_b_{x}": F.coalesce(F.sum(F.col("_e")[x]).over(before), zero) for x in parts})
    upto = running.join(carried, [*own.entity]).select(*p.entity, (F.col(POSITION) + 1).alias("_at"), F.struct(*[(F.col(x) + F.col(f"_b_{x}")).alias(x) for x in parts]).alias("_s"))
    spans = F.array(F.struct(F.lit(0).alias("is_test"), F.col("train_lo").alias("lo"), F.col("train_hi").alias("hi")), F.struct(F.lit(1).alias("is_test"), F.col("test_lo").alias("lo"), F.col("test_hi").alias("hi")))
    borders = fold_table.select(*p.entity, "fold", F.explode(spans).alias("f")).select(*p.entity, "fold", "f.is_test", F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("f.lo").alias("_at")), F.struct(F.lit(1).alias("sign"), F.col("f.hi").alias("_at")))).alias("e"))
    found = borders.select(*p.entity, "fold", "is_test", "e.sign", "e._at").filter("_at > 0").join(upto, [*p.entity, "_at"])
    told = found.groupBy(*p.entity, "fold", "is_test").agg(*[F.sum(F.col("sign") * F.col("_s")[x]).alias(x) for x in parts]).filter("n > 0")
    if values:
        told = told.crossJoin(F.broadcast(centre))
    out = []
    for v in values:
        n, mean = F.col(f"{v}_n"), F.try_divide(F.col(f"{v}_s"), F.col(f"{v}_n"))
        out += [n, (mean + F.col(shift[v])).alias(f"{v}_mean"), F.when(n > 1, F.greatest(F.col(f"{v}_q") - n * mean * mean, F.lit(0.0)) / (n - 1)).alias(f"{v}_var")]
    return told.select(*p.entity, "fold", "is_test", "n", *out, *[f"{c}_{x}" for c, every in labels.items() for x in every])


def carry_by_fold(df: DataFrame, p: Panel, column: str, fold_table: DataFrame, size: int = 100_000, rows_a_range: int | None = None) -> DataFrame:
    """entity, fold, carry: the last known training value of each fold, null without one; only rows of its own training part count, never test rows.

    One row a fold is joined to the row before its border, which knows the last value up to it and where that stood; rows and folds aren't multiplied.
    """
    seen = df.withColumn("_seen", F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("v"))))
    tiled = Tiled.of(seen, p, size, rows_a_range)
    placed = replace(tiled, table=tiled.table.withColumn("_seen", F.when(F.col("_seen").isNotNull(), F.struct(F.col(column).alias("v"), F.col(POSITION).alias("at")))))
    last = placed.last_known("_seen", "_last").table.select(*p.entity, (F.col(POSITION) + 1).alias("train_hi"), "_last")
    found = fold_table.select(*p.entity, "fold", "train_lo", "train_hi").join(last, [*p.entity, "train_hi"], "left")
    return found.select(*p.entity, "fold", F.when(F.col("_last.at") >= F.col("train_lo"), F.col("_last.v")).alias("carry"))


def filled_in_folds(df: DataFrame, p: Panel, column: str, fold_table: DataFrame, name: str, size: int = 100_000, rows_a_range: int | None = None) -> DataFrame:
    """entity, fold, the panel's order and name for every test row of every fold: its last value within the fold's test rows, before the first one the fold's carry, else zero.

    Test rows are dealt to their folds by position; they overlap as far as folds do.
    """
    carry = carry_by_fold(df, p, column, fold_table, size, rows_a_range)
    rows = positioned(df, p, rows_a_range)
    tests = fold_table.select(*p.entity, "fold", F.explode(F.sequence(F.col("test_lo"), F.col("test_hi") - 1)).alias(POSITION)).join(rows, [*p.entity, POSITION]).join(carry, [*p.entity, "fold"])
    w = Window.partitionBy(*p.entity, "fold").orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
    return tests.select(*p.entity, "fold", *p.order, F.coalesce(F.last(column, ignorenulls=True).over(w), "carry", F.lit(0.0)).alias(name))
