"""Near-duplicates by HyperMinHash, confirmed on full shingle sets.

Each document's shingles are hashed by as many functions as there are buckets, and a bucket keeps its smallest value as 16 bits: its count of leading zeros
and the mantissa bits after them. (Buckets are filled by functions of their own and not by parts of one function's range, as most
of those would stay empty for short documents.) Documents with equal shingle sets become one class. Bands of four registers
are themselves the keys under which classes meet. Pairs within a key's bucket are estimated from the registers, corrected for chance
collisions; of those that may be similar enough, a spanning forest is kept, at most one link a member. (In a bucket of more than BUCKET members
all are linked to the smallest one instead, so that no pair is lost.) What hangs together through such links makes a candidate group, whose
pairs are estimated again, and confirmed by the exact sizes of intersection and union.

Large groups are dealt over tiles of bounded size. First each tile, with a few pivots of its group, is searched by itself;
then the tiles are dealt anew by what already hangs together, and all pairs of tiles are searched but those within one
component. So no pair is left out, none is emitted but links that join something, and the work on a group of a component and a few others is
the others' number times its size. What a tile returns is at most one link for each of its members.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.components import components
from tidegauge.llm.shared import RepeatFilter, digest, text_or_empty, written
from tidegauge.llm.words import Remembered

BANDS, ROWS, MANTISSA = 24, 4, 10
BUCKETS = BANDS * ROWS
#: Standard errors of the estimate by which a candidate may miss the threshold and still be confirmed exactly.
MARGIN = 5.0
#: Members and shingles of a tile, pivots of a group.
TILE, TILE_SHINGLES, PIVOTS = 1000, 4_000_000, 16
#: Members of a bucket whose pairs are estimated in one task.
BUCKET = 1000
_RNG = np.random.default_rng(7)
_A = _RNG.integers(0, 2**63, BUCKETS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BUCKETS, dtype=np.uint64)
_PLACE = [np.uint64(x | 1) for x in _RNG.integers(0, 2**63, 64, dtype=np.uint64).tolist()]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@functools.cache
def _word_hashes() -> Remembered:
    return Remembered(lambda w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"), 300_000)


def shingle_set(text: str, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of ``width`` words; of fewer words, the whole sequence; none without words."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    h = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    if not n:
        return h
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _PLACE[k]
    return np.unique(_mixed(total + np.uint64(n)))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The compressed smallest value of each bucket."""
    low = np.full(BUCKETS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[None, at : at + 2048] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
    m, e = np.frexp(low.astype(np.float64))
    zeros = np.clip(64 - e, 0, 63).astype(np.uint16)
    return (zeros << MANTISSA) | np.minimum((2 * m - 1) * 2**MANTISSA, 2**MANTISSA - 1).astype(np.uint16)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of registers that agree by chance for disjoint sets of n and m shingles: two minima, exponential at rates n and m, that fall in one cell, cells being 0.68 of their value times 2**-MANTISSA wide on average."""
    return 0.68 * 2.0**-MANTISSA * n * m / (n + m) ** 2.0


def candidates(n: np.ndarray, regs: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of members that may be similar enough, by their registers and the sizes of their sets."""
    up, down = share
    threshold = up / down
    least = threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / BUCKETS)
    may = np.zeros((len(n), len(n)), bool)
    size = n.astype(np.float64)
    for i in range(len(n) - 1):
        rest = slice(i + 1, None)
        c = chance(size[i], size[rest])
        estimate = ((regs[rest] == regs[i]).mean(axis=1) - c) / (1 - c)
        may[i, rest] = (estimate >= least) & (np.minimum(size[i], size[rest]) * down >= np.maximum(size[i], size[rest]) * up)
    return np.nonzero(may)


def forest(pairs: Iterable[tuple[int, int]], part: list[int]) -> list[tuple[int, int]]:
    """Those pairs that join what does not hang together yet; part: for each member, what it is known to hang together with."""
    roots: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := roots.setdefault(x, x)) != x:
            roots[x] = roots[y]
            x = y
        return x

    found = []
    for i, j in pairs:
        a, b = root(part[i]), root(part[j])
        if a != b:
            roots[a] = b
            found.append((i, j))
    return found


def linked(n: np.ndarray, regs: np.ndarray, sets: list[np.ndarray], part: list[int], share: tuple[int, int]) -> list[tuple[int, int]]:
    """Confirmed links between members that join what does not hang together yet."""
    first, second = candidates(n, regs, share)
    common = _common(sets, first, second)
    union = n[first] + n[second] - common
    similar = common * share[1] >= union * share[0]
    return forest(zip(first[similar].tolist(), second[similar].tolist(), strict=True), part)


def _common(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The exact size of the intersection of each pair."""
    if len(first) < 200:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(first, second, strict=True)], np.int64)
    used = np.unique(np.concatenate([first, second]))
    values, at, count = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    several = count[at] > 1
    row, at = row[several], (np.cumsum(count > 1) - 1)[at[several]]
    a, b = np.searchsorted(used, first), np.searchsorted(used, second)
    out = np.zeros((len(used), len(used)), np.float32)
    for low in range(0, int((count > 1).sum()), 4096):
        own = (at >= low) & (at < low + 4096)
        block = np.zeros((len(used), 4096), np.float32)
        block[row[own], at[own] - low] = 1
        out += block @ block.T
    return out[a, b].astype(np.int64)


def _signed(numbered: DataFrame, width: int) -> DataFrame:
    """For each row: id, row number, size of the set, digest of the set in two numbers, and the registers (null for the empty set)."""
    schema = T.StructType([T.StructField("id", numbered.schema["id"].dataType), *(T.StructField(x, T.LongType()) for x in ("row", "n", "da", "db")), T.StructField("regs", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for cell in batch.column(2):
                s = shingle_set(cell.as_py(), width)
                row = (len(s), *digest(s.tobytes()), registers(s).tobytes()) if len(s) else (0, None, None, None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            arrays = [pa.array(c, pa.int64()) for c in out[:3]] + [pa.array(out[3], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=schema.names)

    return numbered.mapInArrow(run, schema)


def _numbered(df: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """id, row and text; rows that have no number yet are written with one, for a second scan of df may be split otherwise and so number them otherwise."""
    id_, text = F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("text")
    if row_col:
        return df.select(id_, F.col(f"`{row_col}`").alias("row"), text)
    return written(df.select(id_, F.monotonically_increasing_id().alias("row"), text), "numbered")


def _sets(numbered: DataFrame, width: int, wanted: DataFrame, max_filter_bytes: int) -> DataFrame:
    """(row, set) for the wanted rows, and a few more: which ones is told to the tasks by a bitmap of hashed row numbers of bounded size."""
    shared = numbered.sparkSession.sparkContext.broadcast(RepeatFilter(wanted.select(*_hashes()), max_filter_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            own = [i for i, pair in enumerate(hashes) if pair in shared.value]
            sets = [shingle_set(batch.column(1)[i].as_py(), width).tobytes() for i in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int32())), pa.array(sets, pa.binary())], names=["row", "set"])

    return numbered.select("row", "text", *_hashes()).mapInArrow(run, "row long, set binary")


def _hashes() -> list[Column]:
    return [F.xxhash64("row").alias("a"), F.xxhash64("row", F.lit(1)).alias("b")]


def _searched(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) found within each tile; rows: grp, tile, row, part, n, regs, set. A member may come twice."""

    def links(members: list[tuple]) -> list[tuple[int, int]]:
        members = list({m[2]: m for m in members}.values())
        if len(members) < 2:
            return []
        n = np.array([m[4] for m in members], np.int64)
        regs = np.stack([np.frombuffer(m[5], np.uint16) for m in members])
        found = linked(n, regs, [np.frombuffer(m[6], np.uint64) for m in members], [m[3] for m in members], share)
        return [(members[i][2], members[j][2]) for i, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ and open_[0][:2] != member[:2]:
                    found += links(open_)
                    open_ = []
                open_.append(member)
            yield _pairs(found)
        yield _pairs(links(open_))

    order = ["grp", "tile", "row", "part", "n", "regs", "set"]
    return rows.select(*order).repartition("grp", "tile").sortWithinPartitions("grp", "tile", "row").mapInArrow(run, "a long, b long")


def _in_buckets(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) between members of a bucket that may be similar enough, a forest for each; rows: band, key, row, n, regs."""

    def links(members: list[tuple]) -> list[tuple[int, int]]:
        n = np.array([m[3] for m in members], np.int64)
        regs = np.stack([np.frombuffer(m[4], np.uint16) for m in members])
        first, second = candidates(n, regs, share)
        return [(members[i][2], members[j][2]) for i, j in forest(zip(first.tolist(), second.tolist(), strict=True), list(range(len(members))))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ and open_[0][:2] != member[:2]:
                    found += links(open_)
                    open_ = []
                open_.append(member)
            yield _pairs(found)
        if open_:
            yield _pairs(links(open_))

    return rows.select("band", "key", "row", "n", "regs").repartition("band", "key").sortWithinPartitions("band", "key", "row").mapInArrow(run, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _tiles(count: Column, shingles: Column) -> Column:
    """How many tiles so many members with so many shingles take."""
    return F.greatest(F.ceil(count / TILE), F.ceil(shingles / TILE_SHINGLES), F.lit(1)).cast("long")


def _dealt(tiles: Column) -> Column:
    return F.pmod(F.xxhash64("row", F.lit(5)), tiles)


def class_links(classes: DataFrame, numbered: DataFrame, width: int, share: tuple[int, int], max_filter_bytes: int) -> DataFrame:
    """Links (a, b) that join the classes (row, n, regs) into components. No link between different sets that a band shows is lost, but for those that the ones given imply."""
    regs = [F.hex(F.substring("regs", 8 * k + 1, 8)) for k in range(BANDS)]
    bands = classes.select("row", F.posexplode(F.array(*regs)).alias("band", "key"))
    bands = bands.select("row", "band", F.xxhash64("key").alias("key"))
    star = bands.groupBy("band", "key").agg(F.min("row").alias("to"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    met = written(bands.join(star, ["band", "key"]), "met")
    large = met.filter((F.col("k") > BUCKET) & (F.col("row") != F.col("to"))).select(F.col("row").alias("a"), F.col("to").alias("b"))
    small = met.filter(F.col("k") <= BUCKET).select("band", "key", "row").join(classes.select("row", "n", "regs"), "row")
    near = written(large.unionByName(_in_buckets(small, share)).distinct(), "near")
    groups = components(near).select(F.col("node").alias("row"), F.col("root").alias("grp"))
    groups = written(groups.join(classes.select("row", "n", "regs"), "row"), "groups")
    sets = written(_sets(numbered, width, groups.select("row"), max_filter_bytes), "sets")
    full = groups.join(sets, "row")
    sizes = groups.groupBy("grp").agg(_tiles(F.count(F.lit(1)), F.sum("n")).alias("tiles"))
    own = groups.join(sizes, "grp").select("grp", "row", "tiles", _dealt(F.col("tiles")).alias("tile"))
    large = written(own.filter("tiles > 1"), "large")
    pivots = large.groupBy("grp", "tile", "tiles").agg(F.min("row").alias("row")).filter(F.col("tile") < PIVOTS)
    everywhere = pivots.select("grp", "row", "tiles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"))
    places = own.unionByName(everywhere).select("row", "tile")
    first = written(_searched(full.withColumn("part", F.col("row")).join(places, "row"), share), "links")
    if large.isEmpty():
        return first
    return first.unionByName(_across(large.select("grp", "row"), full, first, share))


def _across(members: DataFrame, full: DataFrame, links: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The links of large groups between tiles, dealt by what hangs together already."""
    roots = components(links).select(F.col("node").alias("row"), F.col("root").alias("part"))
    parts = members.join(roots, "row", "left").select("grp", "row", F.coalesce("part", "row").alias("part")).join(full.select("row", "n"), "row")
    sizes = parts.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    big = sizes.filter((F.col("k") > TILE // 4)).select("grp", "part", _tiles(F.col("k"), F.col("s")).alias("big"))
    small = sizes.join(big, ["grp", "part"], "left_anti").groupBy("grp").agg(_tiles(F.sum("k"), F.sum("s")).alias("small"))
    parts = parts.join(big, ["grp", "part"], "left").join(small, "grp", "left")
    of = F.when(F.col("big").isNotNull(), F.col("part")).otherwise(F.lit(-1))
    dealt = parts.select("grp", "row", "part", of.alias("of"), _dealt(F.coalesce("big", "small")).alias("no"))
    dealt = written(dealt, "dealt")
    tiles = dealt.select("grp", "of", "no").distinct()
    other = tiles.select("grp", F.col("of").alias("of2"), F.col("no").alias("no2"))
    pairs = tiles.join(other, "grp").filter("of < of2 or (of = -1 and of2 = -1 and no <= no2)")
    pairs = written(pairs.withColumn("tile", F.monotonically_increasing_id()), "tiles")
    sides = pairs.select("grp", "of", "no", "tile").unionByName(pairs.select("grp", F.col("of2").alias("of"), F.col("no2").alias("no"), "tile"))
    rows = dealt.join(sides.distinct(), ["grp", "of", "no"]).select("row", "part", "tile")
    return written(_searched(full.join(rows, "row"), share), "links")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: tuple[int, int] = (80, 100), max_filter_bytes: int = 32 << 20, row_col: str | None = None) -> DataFrame:
    """id, n_shingles, component_id, kept for every row of df, and its number as ``row``.

    Words are what ASCII white space divides, A-Z in lower case. Rows are linked when share[1] * intersection >= share[0] * union of their sets of
    ``width``-word shingles; component_id is the smallest id of a row's component, and that row is kept (of rows tied in it, the one
    read first; null ids come last). Texts without words, null ones too, are linked with nothing and kept. An empty
    table gives an empty result; further columns are not read. ``row_col`` names a column of df, then a written table, with
    distinct numbers to use as ``row``; without it df is read once.
    """
    numbered = _numbered(df, id_col, text_col, row_col)
    rows = written(_signed(numbered, width), "signed")
    has = rows.filter("n > 0")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    firsts = written(has.groupBy("da", "db").agg(F.min(order).alias("first"), F.min("row").alias("row")), "classes")
    classes = rows.select("row", "n", "regs").join(firsts.select("row"), "row")
    links = class_links(classes, numbered, width, share, max_filter_bytes)
    roots = components(links)
    whole = firsts.join(roots, firsts["row"] == roots["node"], "left").select("da", "db", "first", F.coalesce("root", "row").alias("root"))
    whole = written(whole, "roots")
    best = whole.groupBy("root").agg(F.min("first").alias("best"))
    named = whole.join(best, "root").select("da", "db", "best")
    some = has.join(named, ["da", "db"]).select("id", "row", F.col("n").alias("n_shingles"), F.col("best.id").alias("component_id"), (F.col("best.row") == F.col("row")).alias("kept"))
    none = rows.filter("n = 0").select("id", "row", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return some.unionByName(none).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates among documents on 3-word shingles, at 85 of 100."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_dedup(docs, width=3, share=(85, 100)).select("doc_id", "n_shingles", "component_id", "kept")
