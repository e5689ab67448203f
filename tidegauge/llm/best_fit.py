"""Best-fit packing of tokenised documents by exact-complement hashing.

Documents are tokenised where they are read, and only a short row for each piece goes on. How many pieces there are of each
length is a table of at most ``capacity`` rows, so the plan of which lengths share a sequence is made over
that table, on the driver, whatever the number of pieces. It says, for ranges of pieces of one length, in which sequences
and at which offset they lie. Pieces find their place by their rank among those of their length, which comes from
counts by input partition: no length's pieces ever meet in one task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.shared import free_name, text_or_empty, written
from tidegauge.llm.words import encoder

END = np.array([1], "<u4").tobytes()
#: One slot of a plan: pieces of this length with ranks from `rank` on, `times` of them, go to sequences from `sequence` on, at `offset`.
Slot = tuple[int, int, int, int, int]


def pieces(df: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, and for the packing the input partition and the rank within it."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("rank_in_part", T.LongType())] + [T.StructField("ids", T.BinaryType())] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    for column, value in zip(out, (key, k, at // 4, n, crc32(own), part, seen[n], own), strict=False):
                        column.append(value)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (batch.schema.field(0).type, *kinds), strict=True)], names=schema.names)

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
    return df.select(F.col(f"`{id_col}`"), text_or_empty(f"`{text_col}`")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int) -> list[Slot]:
    """Slots that hold counts[length] pieces of each length in as few sequences as the method finds.

    First, from the longest length down, each gap that the length leaves is filled exactly by one, two or
    three shorter pieces, as often as there are pieces for it. What is left is placed by best fit, longest first. Every
    step uses up a length or a kind of gap, so there are few steps however many pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    ranks = np.zeros(capacity + 1, np.int64)
    slots: list[Slot] = []
    sequence = 0

    def place(length: int, times: int, first: int, offset: int) -> None:
        slots.append((length, int(ranks[length]), times, first, offset))
        ranks[length] += times
        left[length] -= times

    def fill(*lengths: int) -> bool:
        nonlocal sequence
        times = min(int(left[x]) // lengths.count(x) for x in set(lengths))
        if times <= 0:
            return False
        offset = 0
        for x in lengths:
            place(x, times, sequence, offset)
            offset += x
        sequence += times
        return True

    for length in range(capacity, 0, -1):
        gap = capacity - length
        if left[length] and (not gap or left[gap]):
            fill(length, *[gap] * (gap > 0))
        if left[length] and gap > 1:
            shorter = np.flatnonzero(left[1 : gap // 2 + 1]) + 1
            for a in shorter[left[gap - shorter] > 0][::-1].tolist():
                while left[length] and fill(length, gap - a, a):
                    pass
        if left[length] and gap > 2:
            shorter = (np.flatnonzero(left[1 : gap - 1]) + 1).tolist()
            sums = _pair_sums(shorter, gap)
            for a in shorter[::-1]:
                if 3 * a < gap or not left[length]:
                    break
                rest = gap - a
                if not (left[a] and sums >> rest & 1):
                    continue
                low = np.flatnonzero(left[1 : min(rest // 2, a) + 1]) + 1
                for b in low[(left[rest - low] > 0) & (rest - low <= a)][::-1].tolist():
                    while left[length] and left[a] and fill(length, a, rest - b, b):
                        pass
    return slots + best_fit(left, ranks, sequence, capacity)


def _pair_sums(lengths: list[int], below: int) -> int:
    """A bit for each sum of two of the lengths that is below a bound."""
    bits = sum(1 << x for x in lengths)
    sums = 0
    for x in lengths:
        sums |= bits << x
    return sums & ((1 << below) - 1)


def best_fit(left: np.ndarray, ranks: np.ndarray, sequence: int, capacity: int) -> list[Slot]:
    """Slots for what is left of each length: each goes where it leaves the smallest gap, longest first."""
    slots: list[Slot] = []
    gaps: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}

    def opened(gap: int, first: int, times: int) -> None:
        if gap:
            if gap not in open_:
                bisect.insort(gaps, gap)
                open_[gap] = []
            open_[gap].append((first, times))

    for length in range(capacity, 0, -1):
        while n := int(left[length]):
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, times = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
                used = min(n, times)
                if used < times:
                    opened(gap, first + used, times - used)
                slots.append((length, int(ranks[length]), used, first, capacity - gap))
                opened(gap - length, first, used)
                ranks[length] += used
                left[length] -= used
            else:
                each = min(n, capacity // length)
                used = n // each
                for k in range(each):
                    slots.append((length, int(ranks[length]) + k * used, used, sequence, k * length))
                opened(capacity - each * length, sequence, used)
                ranks[length] += each * used
                left[length] -= each * used
                sequence += used
    return slots


def packed(rows: DataFrame, capacity: int) -> DataFrame:
    """rows of :func:`pieces`, written already, with sequence_id and offset in place of part and rank_in_part."""
    spark = rows.sparkSession
    by_part = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    slots = sorted(plan(counts, capacity))
    table = np.array(slots or [(0, 0, 0, 0, 0)], np.int64)
    shift = int(table[:, 1].max()).bit_length() + 1
    shared = spark.sparkContext.broadcast((table, (table[:, 0] << shift) + table[:, 1], shift))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = by_part.select("length", "part", before.alias("before"))
    names = [c for c in rows.columns if c not in ("part", "rank_in_part")]
    ranked = rows.join(starts, ["length", "part"]).select(*names, (F.col("before") + F.col("rank_in_part")).alias("rank"))
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys, shift = shared.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (names.index("length"), len(names)))
            at = np.searchsorted(keys, (length << shift) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])], names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(df: DataFrame, tokenizer: str | None = None, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every text with their sequence and their place in it; with_ids also gives the ids as bytes.

    A text's ids are followed by id 1; only longer ones than ``capacity`` are cut, whole. Null and empty texts are the lone id 1. Repeated
    rows and null ids are packed like any others, ids may be of any type; an empty table gives an empty result. Further columns of df are not
    read. Where the id has the name of a column of the result, that gets an underscore.
    """
    own = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    rows = pieces(own, tokenizer or public_tokenizers.path("word_bpe_49k.json"), capacity, "_id", "_text", with_ids)
    found = packed(written(rows, "pieces"), capacity)
    return found.select(*[F.col(c).alias(id_col if c == "_id" else free_name([id_col], c)) for c in found.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
