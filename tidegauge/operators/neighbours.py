"""Nearest rows of a class by cells around centres, with a proof for each list where the cells' radii allow one."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidegauge.operators.ranges import broadcast_if_small
from tidegauge.sources.sinks import written

#: Rows of a tile of a cell, and rows that ask a tile at once.
MEMBERS, ASKERS = 2_000, 4_000


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), width)


def _flat(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows' vectors, none of them null or with nulls, as a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _away(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a from all of b."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


def near_rows(df: DataFrame, label: str, key: str, x: str, width: int, neighbours: int, max_centres: int = 256, first: float = 0.2, second: float = 0.6) -> DataFrame:
    """(label, key, near, proven): for each row up to so many nearest other rows of its class, as (distance, key), nearest first, ties to the smaller key.

    At most ``max_centres`` rows of a class, by hash, are centres (about the square root of its rows); every row lies in the cell of its nearest centre. A row first asks the
    nearest cells, a share ``first`` of them, two at least. A cell whose nearest possible row, its centre's distance less its radius, is further than a row's last neighbour can't hold
    another one: a row for which that is so of all cells it didn't ask is proven. The others ask, in a second probe, the next cells, a share ``second``, and are proven then or not.
    The defaults find nine in ten neighbours among rows without any order, as test_neighbours measures; rows that lie in groups are proven after the first probe.
    With ``second`` 1 all lists are exact. Cells are searched in tiles of a bounded number of rows, against bounded blocks of those that ask.

    Keys are unique and not null; classes of one row have empty lists; an empty table gives an empty result. Classes are few: their counts come to the driver.
    """
    rows = written(df.select(F.col(label).alias("g"), F.col(key).alias("k"), F.col(x).alias("x")), "near")
    sizes = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    centres = {}
    for g, n in sizes.items():
        own = rows.filter(F.col("g").eqNullSafe(F.lit(g))).orderBy(F.xxhash64("k", F.lit(7)), "k").limit(min(max_centres, math.ceil(math.sqrt(n))))
        centres[g] = _matrix(own.select("x").toArrow()["x"].combine_chunks(), width)  # max_centres rows
    shared = df.sparkSession.sparkContext.broadcast(centres)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    key_type = to_arrow_type(rows.schema["k"].dataType)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            groups, points = batch.column(0).to_pylist(), _matrix(batch.column(2), width)
            for g in set(groups):
                own = np.array([v == g for v in groups])
                d = _away(points[own], shared.value[g])
                cell[own], away[own] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=["g", "k", "x", "cell", "away"])

    cells = written(rows.mapInArrow(placed, f"g {kinds['g']}, k {kinds['k']}, x {kinds['x']}, cell int, away double"), "cells")
    radii = {g: np.full(len(c), -np.inf) for g, c in centres.items()}  # of empty cells: never asked
    for r in cells.groupBy("g", "cell").agg(F.max("away").alias("r")).collect():  # a row a centre
        radii[r["g"]][r["cell"]] = r["r"] * (1 + 1e-9) + 1e-9
    reach = df.sparkSession.sparkContext.broadcast(radii)

    def asking(again: bool):
        """Rows with the cells to ask, and the nearest possible row of those left out. again: for rows with the distance of their last neighbour."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                groups, points = batch.column(0).to_pylist(), _matrix(batch.column(2), width)
                last = batch.column(3).to_numpy(zero_copy_only=False) if again else np.full(len(groups), np.inf)
                asked, bounds = [], []
                for g, p, d in zip(groups, points, last.tolist(), strict=True):
                    away, radius = _away(p[None], shared.value[g])[0], reach.value[g]
                    low = np.where(radius >= 0, np.maximum(away - radius, 0), np.inf)
                    m = int((radius >= 0).sum())
                    order = np.argsort(np.where(radius >= 0, away, np.inf), kind="stable")[:m]
                    head = min(m, max(2, math.ceil(first * m)))
                    if again:
                        rest = order[head:]
                        rest = rest[low[rest] <= d]
                        take = min(len(rest), max(1, math.ceil(second * m))) if len(rest) else 0
                        asked.append(rest[:take].tolist())
                        bounds.append(float(low[rest[take:]].min()) if take < len(rest) else math.inf)
                    else:
                        asked.append(order[:head].tolist())
                        bounds.append(float(low[order[head:]].min()) if head < m else math.inf)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(asked, pa.list_(pa.int32())), pa.array(bounds, pa.float64())], names=["g", "k", "x", "asked", "bound"])

        return run

    counts = cells.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("tiles", F.ceil(F.col("n") / MEMBERS).cast("int")).drop("n")
    members = cells.join(F.broadcast(counts), ["g", "cell"]).withColumn("tile", F.pmod(F.xxhash64("k", F.lit(3)), F.col("tiles")).cast("int"))

    def found(asks: DataFrame) -> DataFrame:
        """(g, k, near): the nearest rows of each asking row among the cells it asks."""
        every = written(asks.select("g", "k", "x", F.explode("asked").alias("cell")), "asked")
        blocks = every.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("blocks")).join(counts, ["g", "cell"])
        left = every.join(F.broadcast(blocks), ["g", "cell"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("block", F.pmod(F.xxhash64("k", F.lit(5)), F.col("blocks")).cast("int"))
        right = members.join(F.broadcast(blocks.select("g", "cell", "blocks")), ["g", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        at = ["g", "cell", "tile", "block"]

        near_type = pa.list_(pa.struct([("distance", pa.float64()), ("k", key_type)]))

        def best(a: pa.Table, b: pa.Table) -> pa.Table:
            """All rows of a block against a tile at once: few candidates a row by matrix distances, with what ties with them, ordered by their exact distances and keys."""
            if not a.num_rows or not b.num_rows:
                return pa.table({"g": a["g"].slice(0, 0), "k": a["k"].slice(0, 0), "near": pa.array([], near_type)})
            p, q = _flat(a["x"], width), _flat(b["x"], width)
            d = _away(p, q)
            mine, theirs = a["k"].combine_chunks(), b["k"].combine_chunks()
            same = pc.index_in(mine, value_set=theirs).to_numpy(zero_copy_only=False)  # keys are unique
            own = np.flatnonzero(~np.isnan(same.astype(np.float64)))
            d[own, same[own].astype(np.int64)] = np.inf
            few = min(neighbours, len(theirs))
            last = np.partition(d, few - 1, axis=1)[:, few - 1]
            i, j = np.nonzero((d <= last[:, None]) & np.isfinite(d))
            exact = np.concatenate([np.sqrt(((p[i[s : s + 65_536]] - q[j[s : s + 65_536]]) ** 2).sum(axis=1)) for s in range(0, max(1, len(i)), 65_536)])
            rank = np.empty(len(theirs), np.int64)
            rank[pc.sort_indices(theirs).to_numpy()] = np.arange(len(theirs))
            order = np.lexsort((rank[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < neighbours
            i, j, exact = i[kept], j[kept], exact[kept]
            ends = np.r_[0, np.cumsum(np.bincount(i, minlength=len(mine)))]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(exact), theirs.take(pa.array(j))], fields=list(near_type.value_type)))
            return pa.table({"g": a["g"], "k": mine, "near": lists})

        parts = left.select(*at, "k", "x").groupBy(*at).cogroup(right.select(*at, "k", "x").groupBy(*at)).applyInArrow(best, f"g {kinds['g']}, k {kinds['k']}, near array<struct<distance:double,k:{kinds['k']}>>")
        return parts.groupBy("g", "k").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, neighbours).alias("near"))

    asks = written(cells.select("g", "k", "x").mapInArrow(asking(False), f"g {kinds['g']}, k {kinds['k']}, x {kinds['x']}, asked array<int>, bound double"), "asks")
    last = F.when(F.size("near") == neighbours, F.element_at("near", -1)["distance"]).otherwise(F.lit(math.inf))
    one = written(asks.drop("asked").join(found(asks), ["g", "k"]).withColumn("last", last).withColumn("proven", F.col("bound") > F.col("last")), "first")
    open_ = one.filter("not proven and bound < double('inf')")
    more = open_.select("g", "k", "x", "last").mapInArrow(asking(True), f"g {kinds['g']}, k {kinds['k']}, x {kinds['x']}, asked array<int>, bound double")
    more = written(more, "asks")
    two = more.select("g", "k", F.col("bound").alias("bound2")).join(found(more.filter(F.size("asked") > 0)).withColumnRenamed("near", "near2"), ["g", "k"], "left")
    both = one.join(two, ["g", "k"], "left").withColumn("near", F.slice(F.array_sort(F.array_distinct(F.concat("near", F.coalesce("near2", F.array().cast(dict(one.dtypes)["near"]))))), 1, neighbours))
    left_out = F.coalesce("bound2", "bound")
    proven = (left_out == math.inf) | (left_out > last)
    return both.select(F.col("g").alias(label), F.col("k").alias(key), "near", proven.alias("proven"))


def oversampled(df: DataFrame, features: list[str], label: str, key: str, neighbours: int = 5, seed: int = 12) -> DataFrame:
    """label, features and is_made: df's rows, and rows between minority rows and near rows of their class, as many for each as bring the class to the size of the largest, or somewhat over.

    A made row lies at a place between a row and one of its neighbours that a hash of its row and number tells, so the same table gives the same rows. Classes of fewer than two
    rows are left as they are; nulls in features of minority classes are an error of the interpolation, so impute before. ``key`` is unique.
    """
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    want = broadcast_if_small(written(per.withColumn("top", F.max("n").over(Window.partitionBy(F.lit(1)))).filter("n < top and n > 1"), "classes"))  # a row a class
    small = written(df.join(want, label).select(label, key, "n", "top", F.array(*[F.col(c).cast("double") for c in features]).alias("x")), "small")
    near = near_rows(small, label, key, "x", len(features), neighbours).filter(F.size("near") > 0)
    copies = small.join(near, [label, key]).withColumn("i", F.explode(F.sequence(F.lit(1), F.ceil((F.col("top") - F.col("n")) / F.col("n")).cast("int"))))
    unit = lambda salt: F.pmod(F.xxhash64(key, "i", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    picked = copies.select(label, "x", unit("u").alias("u"), F.get("near", F.floor(unit("n") * F.size("near")).cast("int"))["k"].alias("_other"))
    other = small.select(F.col(label), F.col(key).alias("_other"), F.col("x").alias("v"))
    made = picked.join(other, [label, "_other"]).select(label, F.zip_with("x", "v", lambda a, b: a + F.col("u") * (b - a)).alias("x"))
    made = made.select(label, *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(features)], F.lit(1).alias("is_made"))
    return df.select(label, *features, F.lit(0).alias("is_made")).unionByName(made)
