"""Walk-forward folds, and baselines that need no fitting loop: each is one window or aggregation over a panel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalars import ratio


def folds(df: DataFrame, entity: list[str], initial: int, test_size: int = 1, step: int = 1, rolling: int | None = None) -> DataFrame:
    """entity, fold, train_lo, train_hi, test_lo, test_hi: positions, ends exclusive, for each entity's number of rows; a partial tail is dropped."""
    if min(initial, test_size, step) < 1 or rolling is not None and rolling < 1:
        raise ValueError("sizes must be positive")
    n = df.groupBy(*entity).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= initial + test_size)
    starts = n.select(*entity, F.posexplode(F.sequence(F.lit(initial).cast("long"), F.col("n") - test_size, F.lit(step).cast("long"))).alias("fold", "test_lo"))
    low = F.lit(0).cast("long") if rolling is None else F.greatest(F.col("test_lo") - rolling, F.lit(0).cast("long"))
    return starts.select(*entity, "fold", low.alias("train_lo"), F.col("test_lo").alias("train_hi"), "test_lo", (F.col("test_lo") + test_size).alias("test_hi"))


def positions(df: DataFrame, entity: list[str], order: list[str]) -> DataFrame:
    """df with pos, from 0 within each entity."""
    return df.withColumn("pos", (F.row_number().over(Window.partitionBy(*entity).orderBy(*order)) - 1).cast("long"))


def members(rows: DataFrame, fold_table: DataFrame, entity: list[str]) -> DataFrame:
    """Rows by fold with is_test: an equi-join on entity with a range on positions."""
    joined = rows.join(fold_table, entity).filter((F.col("pos") >= F.col("train_lo")) & (F.col("pos") < F.col("test_hi")))
    return joined.select(*rows.columns, "fold", (F.col("pos") >= F.col("test_lo")).cast("int").alias("is_test"))


def majority_so_far(p, label: str, labels: list[str]) -> tuple[Column, dict[str, Column]]:
    """The most frequent label among earlier rows, ties to the first in sorted order, and each label's share; null on the first row."""
    before = p.window.rowsBetween(Window.unboundedPreceding, -1)
    counts = {x: F.sum((F.col(label) == x).cast("long")).over(before) for x in sorted(labels)}
    total = F.count(label).over(before)
    best = F.greatest(*counts.values())
    pick = F.coalesce(*[F.when(c == best, x) for x, c in counts.items()])
    return F.when(total > 0, pick), {x: F.try_divide(c, total) for x, c in counts.items()}


def persistence(p, label: str) -> Column:
    """The label before."""
    return F.lag(label).over(p.window)


def expanding_line(p, x: str, y: str, least: int = 3) -> tuple[Column, Column]:
    """Slope and intercept of least squares over earlier rows where both are known; null with too few or without spread."""
    w = p.window.rowsBetween(Window.unboundedPreceding, -1)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    s = lambda c: F.sum(F.when(both, c)).over(w)
    n = F.count(F.when(both, 1)).over(w)
    sx, sy, sxx, sxy = s(F.col(x)), s(F.col(y)), s(F.col(x) * F.col(x)), s(F.col(x) * F.col(y))
    slope = F.when(n >= least, ratio(n * sxy - sx * sy, n * sxx - sx * sx))
    return slope, ratio(sy - slope * sx, n.cast("double"))


#: How far a value may stand from the previous one and still be held.
HELD_WITHIN = 0.125


def given_rule(xs: dict[str, float], intercept: float) -> Column:
    """A linear rule with fixed coefficients by column; null where a column is."""
    return sum((F.col(c) * b for c, b in xs.items()), F.lit(float(intercept)))


def direction(value: Column, previous: Column, within: float = HELD_WITHIN) -> Column:
    """hike or cut where a value is further than that above or below the previous one, else hold; null where either is."""
    delta = value - previous
    return F.when(delta > within, "hike").when(delta < -within, "cut").when(delta.isNotNull(), "hold")


def policy_rule(df: DataFrame, p, xs: list[str], y: str, weight: str | None = None, least: int | None = None) -> DataFrame:
    """df with intercept, slope_<x> for each regressor and prescribed: (weighted) least squares on all earlier rows of the entity, applied to the row's own regressors.

    Rows where a regressor, y or the weight is null, or the weight is not positive, are not learnt from; with fewer than ``least`` of them (one more than the
    regressors, unless given), or where the regressors hang together (a pivot below 1e-10 of its sum of squares), all are null. Sums of cross-products run
    over a window, about the entity's first usable row so that they stay small, and the normal equations are solved by elimination in projections.
    """
    least = least or len(xs) + 1
    w = p.window.rowsBetween(Window.unboundedPreceding, -1)
    ever = Window.partitionBy(*p.entity).orderBy(*p.order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    good = F.lit(True)
    for c in (*xs, y):
        good = good & F.col(c).isNotNull()
    rows = df.withColumn("_g", good & F.coalesce(own > 0, F.lit(False)))
    rows = rows.withColumns({f"_o{i}": F.first(F.when(F.col("_g"), F.col(c).cast("double")), ignorenulls=True).over(ever) for i, c in enumerate((*xs, y))})
    k = len(xs)
    z = [F.col(c).cast("double") - F.col(f"_o{i}") for i, c in enumerate((*xs, y))]
    sums = {"_n": F.count(F.when(F.col("_g"), 1)).over(w), "_w": F.sum(F.when(F.col("_g"), own)).over(w)}
    sums |= {f"_s{i}": F.sum(F.when(F.col("_g"), own * z[i])).over(w) for i in range(k + 1)}
    sums |= {f"_p{i}_{j}": F.sum(F.when(F.col("_g"), own * z[i] * z[j])).over(w) for i in range(k) for j in range(i, k + 1)}
    rows = rows.withColumns(sums)
    # about the means: what is left of the cross-products
    rows = rows.withColumns({f"_a{i}_{j}": F.col(f"_p{i}_{j}") - ratio(F.col(f"_s{i}") * F.col(f"_s{j}"), F.col("_w")) for i in range(k) for j in range(i, k + 1)})
    rows = rows.withColumns({f"_d{i}": F.col(f"_a{i}_{i}") for i in range(k)})
    for i in range(k):  # elimination of the symmetric matrix, each step a projection
        pivot = F.when(F.col(f"_a{i}_{i}") > 1e-10 * F.col(f"_d{i}"), F.col(f"_a{i}_{i}"))
        rows = rows.withColumns({f"_a{m}_{j}": F.col(f"_a{m}_{j}") - F.col(f"_a{i}_{m}") * F.col(f"_a{i}_{j}") / pivot for m in range(i + 1, k) for j in range(m, k + 1)} | {f"_v{i}": pivot})
    enough = F.col("_n") >= least
    for i in range(k - 1, -1, -1):
        rest = sum((F.col(f"_a{i}_{j}") * F.col(f"slope_{xs[j]}") for j in range(i + 1, k)), F.lit(0.0))
        rows = rows.withColumn(f"slope_{xs[i]}", F.when(enough, (F.col(f"_a{i}_{k}") - rest) / F.col(f"_v{i}")))
    mean = lambda i: F.col(f"_o{i}") + ratio(F.col(f"_s{i}"), F.col("_w"))
    intercept = mean(k) - sum((F.col(f"slope_{x}") * mean(i) for i, x in enumerate(xs)), F.lit(0.0))
    rows = rows.withColumn("intercept", F.when(enough, intercept))
    told = sum((F.col(f"slope_{x}") * F.col(x) for x in xs), F.col("intercept"))
    return rows.select(*df.columns, "intercept", *[f"slope_{x}" for x in xs], told.alias("prescribed"))


def implied_probabilities(delta: Column, step: float = 0.25) -> dict[str, Column]:
    """cut, hike and hold shares that an implied change leaves: what of a whole step it covers."""
    clip = lambda c: F.least(F.greatest(c / step, F.lit(0.0)), F.lit(1.0))
    hike, cut = clip(delta), clip(-delta)
    return {"cut": cut, "hike": hike, "hold": 1 - cut - hike}


def first_best(proba: dict[str, Column]) -> Column:
    """The label with the largest value, ties to the first in sorted order; null if any is null."""
    best = F.greatest(*proba.values())
    known = F.lit(True)
    for c in proba.values():
        known = known & c.isNotNull()
    return F.when(known, F.coalesce(*[F.when(proba[x] == best, x) for x in sorted(proba)]))


def contract_for(event: Column) -> tuple[Column, Column, Column]:
    """Month of the contract to read for an event, share of its month after it, and whether that is the event's own month (at least half of it left)."""
    left = (F.day(F.last_day(event)) - F.day(event)) / F.day(F.last_day(event))
    own = left >= 0.5
    return F.when(own, F.trunc(event, "MM")).otherwise(F.add_months(F.trunc(event, "MM"), 1)), left, own


def rate_after(contract: Column, current: Column, left: Column, own: Column) -> Column:
    """The rate after an event: its own month's mean unwound, or the next month's as it is."""
    return F.when(own, ratio(contract - (1 - left) * current, left)).otherwise(contract)


def weighted_choice(proba: dict[str, Column], weights: dict[str, float]) -> Column:
    """The label whose weighted probability is largest, first in sorted order on ties."""
    return first_best({x: c * weights[x] for x, c in proba.items()})


def tuned_weights(df: DataFrame, proba: dict[str, str], grid: list[float]) -> DataFrame:
    """(weights..., accuracy, balanced_accuracy, macro_f1): every point of a grid of weights is scored from one table of counts. The grid is a short list."""
    labels = sorted(proba)
    points = [()]
    for _ in labels[1:]:
        points = [(*x, g) for x in points for g in grid]
    spark = df.sparkSession
    table = spark.createDataFrame([(1.0, *x) for x in points], ", ".join(f"w_{x} double" for x in labels))
    rows = df.crossJoin(F.broadcast(table))
    pick = first_best({x: F.col(proba[x]) * F.col(f"w_{x}") for x in labels})
    cells = rows.groupBy(*table.columns, "y_true", pick.alias("_pick")).agg(F.count(F.lit(1)).alias("n"))
    of = lambda x, t, p: F.sum(F.when(((F.col("y_true") == x) == t) & ((F.col("_pick") == x) == p), F.col("n")).otherwise(0))
    tp, fn, fp = ({x: of(x, *how) for x in labels} for how in ((True, True), (True, False), (False, True)))
    recalls = F.array_compact(F.array(*[F.try_divide(tp[x], tp[x] + fn[x]) for x in labels]))
    f1 = sum((F.coalesce(F.try_divide(2.0 * tp[x], 2 * tp[x] + fp[x] + fn[x]), F.lit(0.0)) for x in labels), F.lit(0.0)) / len(labels)
    hit = F.sum(F.when(F.col("y_true") == F.col("_pick"), F.col("n")).otherwise(0)) / F.sum("n")
    mean = F.aggregate(recalls, F.lit(0.0), lambda s, v: s + v) / F.size(recalls)
    return cells.groupBy(*table.columns).agg(hit.alias("accuracy"), mean.alias("balanced_accuracy"), f1.alias("macro_f1"))


def best_weights(table: DataFrame, by: str, labels: list[str]) -> dict[str, float]:
    """The weights of the best point of :func:`tuned_weights` by a score, ties to the first in the grid's order, scaled to a geometric mean of 1."""
    row = table.orderBy(F.desc(F.round(by, 9)), *[f"w_{x}" for x in labels]).head()
    own = {x: row[f"w_{x}"] for x in labels}
    mean = math.exp(sum(math.log(w) for w in own.values()) / len(own))
    return {x: w / mean for x, w in own.items()}


def voted(members_: DataFrame, key: list[str], weight: str | None = None) -> DataFrame:
    """key and the label with most (weighted) votes, ties to the first in sorted order."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    votes = members_.groupBy(*key, "y_pred").agg(F.sum(w).alias("votes"))
    best = Window.partitionBy(*key).orderBy(F.desc("votes"), "y_pred")
    return votes.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(*key, "y_pred", "votes")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """df with weight: n / (classes * rows of the class)."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = per.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(per.crossJoin(F.broadcast(total))), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def is_test(day: Column, cutoff) -> Column:
    """1 from the cutoff on, 0 before; null days are in neither part."""
    return (day >= F.lit(cutoff).cast("date")).cast("int")
