"""Mutual information of continuous features and a label by nearest neighbours, over tables of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators import ranges
from tidegauge.operators.evaluate import information_of_counts
from tidegauge.operators.ranges import broadcast_if_small, in_ranges, range_offsets
from tidegauge.sources.sinks import written

#: An integer-valued feature with at most so many distinct values is discrete.
MOST_DISTINCT = 10


def digamma(n: Column) -> Column:
    """The digamma function of whole numbers from 1 on, to 12 digits or more: its series ten places further on, and back by its recurrence."""
    m = n.cast("double") + 10
    series = F.log(m) - 1 / (2 * m) - 1 / (12 * m * m) + 1 / (120 * m * m * m * m) - 1 / (252 * m * m * m * m * m * m)
    return series - sum((1 / (n.cast("double") + i) for i in range(10)), F.lit(0.0))


def _digammas(n: np.ndarray) -> np.ndarray:
    """:func:`digamma` of an array."""
    m = n.astype(np.float64) + 10
    return np.log(m) - 1 / (2 * m) - 1 / (12 * m**2) + 1 / (120 * m**4) - 1 / (252 * m**6) - sum(1 / (n + float(i)) for i in range(10))


_SCANNED = "feature string, y string, x double, n long, open boolean, radius double, closed_k double, closed_m double"


def _scan(neighbours: int):
    """Of the cells (feature, y, x, n) of one range: for each feature the sums of n digamma(k) and n digamma(m) over cells whose reach ends within the range, and as rows the cells at the
    range's ends, by class: those that are open, and as many beside them as their neighbours, here and in other ranges, may be.

    A cell that has so many rows of its class on either side within the range reaches no further than these do, so at most twice ``neighbours`` cells a class and range are open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        rows = pa.Table.from_batches(some)  # one range
        feature, y = (rows[c].combine_chunks().dictionary_encode() for c in ("feature", "y"))
        f, g, x, n = feature.indices.to_numpy(), y.indices.to_numpy(), rows["x"].to_numpy(), rows["n"].to_numpy()
        order = np.lexsort((x, g, f))
        f, g, x, n = f[order], g[order], x[order], n[order]
        times = np.minimum(n, neighbours + 1)  # more of one value tell nothing more
        at = np.cumsum(times) - times
        every = np.repeat(x, times)
        first = np.r_[True, (f[1:] != f[:-1]) | (g[1:] != g[:-1])]
        begin = at[first][np.cumsum(first) - 1]
        end = np.r_[at[first][1:], len(every)][np.cumsum(first) - 1]
        radius = np.full(len(x), np.inf)
        for j in range(neighbours + 1):
            left, right = at - j, at + neighbours - j
            a = np.where(left >= begin, x - every[np.maximum(left, 0)], np.inf)
            b = np.where(right < end, every[np.minimum(right, len(every) - 1)] - x, np.inf)
            radius = np.minimum(radius, np.maximum(a, b))
        flat = n > neighbours
        radius[flat] = 0.0
        known = flat | ((at - neighbours >= begin) & (at + neighbours < end))
        edge = (at - begin < 2 * neighbours) | (end - at - times < 2 * neighbours)
        closed, sums = flat.copy(), []
        for v in range(len(feature.dictionary)):
            own = f == v
            sort = np.argsort(x[own], kind="stable")
            values, upto = x[own][sort], np.r_[0, np.cumsum(n[own][sort])]
            low, high = x[own] - radius[own], x[own] + radius[own]
            closed[own] |= known[own] & (low >= values[0]) & (high <= values[-1])
            m = np.where(flat[own], upto[np.searchsorted(values, x[own], "right")] - upto[np.searchsorted(values, x[own], "left")], upto[np.searchsorted(values, high, "left")] - upto[np.searchsorted(values, low, "right")])
            c = closed[own]
            weight = n[own][c]
            sums.append((float((weight * _digammas(np.where(flat[own][c], weight, neighbours))).sum()), float((weight * _digammas(m[c])).sum())))
        names = feature.dictionary
        told = len(sums)
        none = lambda kind: pa.nulls(told, kind)
        yield pa.RecordBatch.from_arrays([names, none(pa.string()), none(pa.float64()), none(pa.int64()), none(pa.bool_()), none(pa.float64()), pa.array([a for a, _ in sums]), pa.array([b for _, b in sums])], names=_NAMES)
        kept = edge | ~closed
        yield pa.RecordBatch.from_arrays([names.take(pa.array(f[kept])), y.dictionary.take(pa.array(g[kept])), pa.array(x[kept]), pa.array(n[kept]), pa.array(~closed[kept]), pa.array(radius[kept], mask=~known[kept]), pa.nulls(int(kept.sum()), pa.float64()), pa.nulls(int(kept.sum()), pa.float64())], names=_NAMES)

    return run


_NAMES = [c.split()[0] for c in _SCANNED.split(", ")]


def _reach(edges: DataFrame, sizes: DataFrame, neighbours: int) -> DataFrame:
    """The open ones of the ranges' edge cells with k and radius: the distance of the k-th nearest other row of the feature and label.

    k is ``neighbours``, or all others of a smaller class; where that many have the row's own value, the radius is 0 and k is how many of the class have it.
    """
    near = F.collect_list(F.struct("x", "n")).over(Window.partitionBy("feature", "y").orderBy("x").rowsBetween(-neighbours, neighbours))
    rows = edges.withColumn("_near", near).filter("open").join(sizes, ["feature", "y"]).withColumn("k", F.least(F.col("size") - 1, F.lit(neighbours)))
    told = F.array_sort(F.transform("_near", lambda c: F.struct(F.abs(c["x"] - F.col("x")).alias("d"), (c["n"] - F.when(c["x"] == F.col("x"), 1).otherwise(0)).alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("d"))
    reach = F.aggregate(told, start, lambda s, c: F.struct((s["n"] + c["n"]).alias("n"), F.when(s["n"] >= F.col("k"), s["d"]).otherwise(c["d"]).alias("d")))
    out = rows.select("feature", "y", "x", "n", "k", F.coalesce("radius", reach["d"]).alias("radius"))
    return out.withColumn("k", F.when(F.col("radius") == 0, F.col("n")).otherwise(F.col("k")))


def _below(cells: DataFrame, ends: DataFrame) -> DataFrame:
    """ends (feature, v, side: 0 before and 2 after rows at v) with upto: how many of the cells' rows stand below. Few ends are counted between in one scan of the cells, without a shuffle; many are put in one order with the cells, in ranges."""
    if ends.count() > ranges.MOST_BROADCAST:
        given = cells.groupBy("feature", F.col("x").alias("v")).agg(F.sum("n").alias("n")).select("feature", "v", F.lit(1).alias("side"), "n")
        placed = in_ranges(given.unionByName(ends.withColumn("n", F.lit(0).cast("long"))), ["feature"], ["v", "side"])
        offsets = range_offsets(placed, ["feature"], {"_before": F.sum("n")}).drop("_before_own")
        upto = F.sum("n").over(Window.partitionBy("feature", "range").orderBy("v", "side").rangeBetween(Window.unboundedPreceding, 0))
        return placed.withColumn("_upto", upto).filter("side <> 1").join(broadcast_if_small(offsets), ["feature", "range"]).select("feature", "v", "side", (F.col("_before") + F.col("_upto")).alias("upto"))
    at: dict[tuple, np.ndarray] = {}
    for r in ends.groupBy("feature", "side").agg(F.sort_array(F.collect_list("v")).alias("v")).collect():  # at most MOST_BROADCAST numbers
        at[r["feature"], r["side"]] = np.array(r["v"])
    shared = cells.sparkSession.sparkContext.broadcast(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {key: np.zeros(len(v) + 1, np.int64) for key, v in shared.value.items()}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            f, x, n = coded.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i, name in enumerate(coded.dictionary.to_pylist()):
                for side in (0, 2):
                    if (name, side) in found:
                        own = f == i  # counts of rows are whole numbers, so doubles hold them
                        slot = np.searchsorted(shared.value[name, side], x[own], "left" if side else "right")
                        found[name, side] += np.bincount(slot, n[own], len(found[name, side])).astype(np.int64)
        for (name, side), counts in found.items():
            some = np.flatnonzero(counts[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array([side] * len(some), pa.int32()), pa.array(shared.value[name, side][some]), pa.array(counts[some])], names=["feature", "side", "v", "n"])

    between = cells.select("feature", "x", "n").mapInArrow(run, "feature string, side int, v double, n long").groupBy("feature", "side", "v").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("feature", "side").orderBy("v"))  # a row an end
    return ends.join(between, ["feature", "side", "v"], "left").select("feature", "v", "side", F.coalesce("n", F.lit(0)).alias("n")).select("feature", "v", "side", upto.alias("upto"))


def continuous_information(df: DataFrame, features: list[str], label: str, least: int = 30, neighbours: int = 3) -> DataFrame:
    """(feature, mi) in nats of continuous features and a label, by the distance to each row's k-th nearest row of its own class.

    With N rows, k and n the neighbours and rows of a row's class, and m the rows of any class that are nearer than that distance (with itself; where the distance
    is 0, k and m are the rows of equal value, of its class and of any): mi = digamma(N) + the means of digamma(k) - digamma(n) - digamma(m), 0 at least. Rows whose class is alone are
    left out, and so are those where either is null. Features with fewer than ``least`` rows get null, those of one value 0. No noise is added, so ties count as they are.

    Cells of equal values are dealt into ranges of a feature once, each of which is summed up by itself; only the few cells at its ends (see :func:`_scan`) are looked at across ranges.
    """
    cells = _cells(df.filter(F.col(f"`{label}`").isNotNull()), features, label)
    return _of_cells(cells, _sizes(cells), least, neighbours)


def _cells(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, y, x, n), written: the rows of each class and known value of a feature."""
    long = df.select(F.col(f"`{label}`").cast("string").alias("y"), *[F.col(f"`{c}`").cast("double").alias(c) for c in features]).unpivot("y", features, "feature", "x").filter("x is not null")
    return written(long.groupBy("feature", "y", "x").agg(F.count(F.lit(1)).alias("n")), "cells")


def _sizes(cells: DataFrame) -> DataFrame:
    """(feature, y, size, values, low, high, whole), written: rows and distinct values of a class, the least and largest, and whether all are whole numbers (1 or 0)."""
    whole = F.min((F.col("x") == F.floor("x")).cast("int"))
    return written(cells.groupBy("feature", "y").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("values"), F.min("x").alias("low"), F.max("x").alias("high"), whole.alias("whole")), "sizes")


def _of_cells(cells: DataFrame, sizes: DataFrame, least: int, neighbours: int) -> DataFrame:
    """:func:`continuous_information` of written cells and their sizes, of known classes."""
    seen = sizes.groupBy("feature").agg(F.sum("size").alias("n_obs"), (F.min("low") == F.max("high")).alias("_flat"))
    told = sizes.agg(F.sum(F.when(F.col("size") > 1, F.col("values"))).alias("cells"), F.count_if(F.col("size") == 1).alias("alone")).head()
    if told["alone"]:
        cells = cells.join(broadcast_if_small(sizes.filter("size = 1").select("feature", "y")), ["feature", "y"], "left_anti").select("feature", "y", "x", "n")
    sizes = broadcast_if_small(sizes.filter("size > 1").select("feature", "y", "size"))
    n = max(1, -(-(told["cells"] or 0) // ranges.RANGE_ROWS))
    scanned = written(cells.repartitionByRange(n, "feature", "x").mapInArrow(_scan(neighbours), _SCANNED), "scanned")
    open_ = written(_reach(scanned.filter("y is not null").drop("closed_k", "closed_m"), sizes, neighbours), "open")
    flat = F.col("radius") == 0
    ends = F.array(F.struct((F.col("x") - F.col("radius")).alias("v"), F.when(flat, 0).otherwise(2).alias("side"), F.lit(-1).alias("sign")), F.struct((F.col("x") + F.col("radius")).alias("v"), F.when(flat, 2).otherwise(0).alias("side"), F.lit(1).alias("sign")))
    asked = open_.withColumn("e", F.explode(ends)).select("feature", "y", "x", "n", "k", "e.v", "e.side", "e.sign")
    upto = _below(cells, written(asked.select("feature", "v", "side").distinct(), "ends"))
    counts = asked.join(upto, ["feature", "v", "side"]).groupBy("feature", "y", "x").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.sum(F.col("sign") * F.col("upto")).alias("m"))
    parts = counts.select("feature", (F.col("n") * digamma(F.col("k"))).alias("a"), (F.col("n") * digamma(F.col("m"))).alias("b"))
    parts = parts.unionByName(scanned.filter("y is null").select("feature", F.col("closed_k").alias("a"), F.col("closed_m").alias("b"))).groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    classes = sizes.groupBy("feature").agg(F.sum("size").alias("N"), F.sum(F.col("size") * digamma(F.col("size"))).alias("c"))
    own = classes.join(F.broadcast(parts), "feature").select("feature", F.greatest(digamma(F.col("N")) + (F.col("a") - F.col("c") - F.col("b")) / F.col("N"), F.lit(0.0)).alias("_mi"))
    mi = F.when(F.col("n_obs") < least, None).when(F.col("_flat"), 0.0).otherwise(F.coalesce("_mi", F.lit(0.0)))
    return seen.join(F.broadcast(own), "feature", "left").select("feature", mi.alias("mi"))  # a row a feature


def _discrete(cells: DataFrame, sizes: DataFrame) -> list[str]:
    """The discrete features of cells; values are looked at only of those that have few in every class."""
    few = sizes.groupBy("feature").agg(F.min("whole").alias("whole"), F.max("values").alias("values")).filter(f"whole = 1 and values <= {MOST_DISTINCT}")
    some = cells.filter(F.col("feature").isin([r["feature"] for r in few.collect()]))
    values = some.groupBy("feature", "x").agg(F.first("n")).groupBy("feature").agg(F.count(F.lit(1)).alias("values"))
    return sorted(r["feature"] for r in values.filter(f"values <= {MOST_DISTINCT}").collect())


def discrete_features(df: DataFrame, features: list[str]) -> list[str]:
    """Those of the features that have whole numbers only and at most MOST_DISTINCT distinct values; one row a feature comes to the driver."""
    cells = _cells(df.withColumn("_label", F.lit(None)), features, "_label")
    return _discrete(cells, _sizes(cells))


def information(df: DataFrame, features: list[str], label: str, least: int = 30, neighbours: int = 3) -> DataFrame:
    """(feature, mi): of discrete features from joint counts, of the others by nearest neighbours; both from the same cells, for which df is read once."""
    cells = _cells(df, features, label)
    sizes = _sizes(cells)
    discrete = _discrete(cells, sizes)
    cells, sizes = (x.filter("y is not null") for x in (cells, sizes))
    is_discrete = F.col("feature").isin(discrete)
    parts = []
    if discrete:
        parts.append(information_of_counts(cells.filter(is_discrete), least))
    if len(discrete) < len(features):
        parts.append(_of_cells(cells.filter(~is_discrete), sizes.filter(~is_discrete), least, neighbours))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
