"""Importance resampling towards a target's distribution of hashed word runs.

A feature is a run of one to three words; its bucket is a checksum of its bytes. Buckets are computed for whole slices of texts at once: the
distinct features of a slice are dealt by their length in bytes into two-dimensional arrays, one row a byte place and one column a feature, and all
checksums of an array are brought forward place by place, then scattered back to where the features stand. The buckets of each text are
written once, sorted and as differences; the counts of both tables, the texts' weights, and the draw come from that table.

The draw takes the largest sums of weight and Gumbel noise. Ranks come from ranges of the scores that are written with their counts, so no task sorts all rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.shared import in_byte_slices, in_slices, written
from tidegauge.llm.spans import Words, words_of

_BYTE = np.arange(256)
#: Bytes of words: digits, small letters, and all of characters beyond ASCII; capital letters of ASCII become small ones first.
IS_WORD = (_BYTE >= 0x30) & (_BYTE <= 0x39) | (_BYTE >= 0x61) & (_BYTE <= 0x7A) | (_BYTE >= 0x80)
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)
#: Most words whose features are made at once, and most cells of one array of features.
SEGMENT, CELLS = 400_000, 8_000_000
#: Arrays with fewer features than this are quicker to check one by one.
FEW = 12


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


TABLE = _crc_table()


def crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each piece data[start : start + size], all pieces of one size together."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(sizes, kind="stable")
    lengths, first = np.unique(sizes[order], return_index=True)
    for size, own in zip(lengths.tolist(), np.split(order, first[1:]), strict=True):
        if len(own) < FEW:
            out[own] = [zlib.crc32(data[a : a + size]) for a in starts[own].tolist()]
            continue
        step = max(1, CELLS // max(1, size))
        for part in (own[at : at + step] for at in range(0, len(own), step)):
            matrix = data[starts[part][None, :] + np.arange(size)[:, None]]
            crc = np.full(len(part), 0xFFFFFFFF, np.uint32)
            for column in matrix:
                crc = TABLE[crc.astype(np.uint8) ^ column] ^ (crc >> np.uint32(8))
            out[part] = ~crc
    return out


def features(words: Words, buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every feature: the runs of 1 to ``longest`` words of one text, in parts of the words."""
    data, starts = words.joined()
    ends = starts + words.sizes
    for a in range(0, len(starts), SEGMENT):
        b = min(len(starts), a + SEGMENT + longest - 1)  # runs that start in this part may end beyond it
        own = Words(words.data[words.ends[a] - words.sizes[a] : words.ends[b - 1]], words.ends[a:b] - (words.ends[a] - words.sizes[a]), words.text[a:b])
        single, many = own.codes()
        starting = min(SEGMENT, b - a)
        at, codes = np.arange(starting), single[:starting]
        texts, found = [], []
        for size in range(1, longest + 1):
            if size > 1:
                more = at + size - 1 < b - a
                at, codes = at[more], codes[more]
                same = own.text[at] == own.text[at + size - 1]
                at, codes = at[same], codes[same]
                codes = pa.array(codes * many + single[at + size - 1]).dictionary_encode().indices.to_numpy().astype(np.int64)
            if not len(at):
                break
            first = np.zeros(codes.max() + 1, np.int64)
            first[codes[::-1]] = at[::-1]  # one place for each distinct feature
            begin = starts[a + first]
            distinct = (crcs(data, begin, ends[a + first + size - 1] - begin) % buckets).astype(np.int64)
            texts.append(own.text[at])
            found.append(distinct[codes])
        yield np.concatenate(texts), np.concatenate(found)


def _packed(words: Words, count: int, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Words and features of so many texts, and the buckets of all features, sorted by text and bucket and as 32-bit differences within a text."""
    parts = [text * buckets + bucket for text, bucket in features(words, buckets, longest)]
    keys = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    text, bucket = keys // buckets, keys % buckets
    step = np.diff(bucket, prepend=0)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    step[first] = bucket[first]
    return np.bincount(words.text, minlength=count), np.bincount(text, minlength=count), step.astype("<u4").tobytes()


def hashed_features(df: DataFrame, id_col: str | None, text_col: str, buckets: int, longest: int) -> DataFrame:
    """(id, n_words, n_features, packed) of every row, written. packed: its features' buckets, as differences of the sorted ones."""
    columns = [F.col(f"`{id_col}`").alias("id")] if id_col else [F.lit(None).cast("long").alias("id")]
    rows = df.select(*columns, F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_byte_slices(in_slices(batches, 5000), 1):
            n_words, n, packed = _packed(words_of(batch.column(1), IS_WORD, LOWER), batch.num_rows, buckets, longest)
            ends = np.concatenate([[0], np.cumsum(4 * n)])
            cells = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)), cells], names=schema.names)

    return written(rows.mapInArrow(run, schema), "features")


def _unpacked(packed: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all rows, and where those of each row start."""
    cells = packed.cast(pa.large_binary())
    at = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1]
    step = np.frombuffer(cells.buffers()[2], "<u4", (at[-1] - at[0]) // 4, at[0]).astype(np.int64) if at[-1] > at[0] else np.zeros(0, np.int64)
    starts = np.cumsum(n) - n
    some = starts[n > 0]
    sums = np.cumsum(step)
    return sums - np.repeat(sums[some] - step[some], n[n > 0]), starts


def bucket_counts(hashed: DataFrame, buckets: int) -> np.ndarray:
    """How many features lie in each bucket; tasks send on sums, one row a bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in in_slices(batches, 500):
            total += np.bincount(_unpacked(batch.column(0), batch.column(1).to_numpy())[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    sums = hashed.select("packed", "n_features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket the logarithm of its smoothed share in the target over that in the source, in thousandths, rounded down."""
    k, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def ranked(rows: DataFrame, draw: int) -> DataFrame:
    """rows (id, score, ...) with rank, 1 for the highest score and the smaller id on ties; null beyond the first ``draw``.

    Rows are written in ranges of (score, id) with the number of their range; a row's rank is the number of rows in earlier ranges and its place in its own.
    """
    ranges = written(rows.repartitionByRange(F.desc("score"), F.asc_nulls_last("id")).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    rank = F.col("before") + F.col("place")
    return ranges.withColumn("place", place).join(F.broadcast(before), "range").select(*rows.columns, F.when(rank <= draw, rank).alias("rank"))


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = 10_000, longest: int = 3, least_words: int = 20, percent: int = 5, seed: str = "42") -> DataFrame:
    """id, n_words, n_features, weight, score and rank of every row of df.

    A row's weight is the sum of its features' gains, by the target's share of their buckets over df's; its score adds Gumbel noise, which depends on
    seed and id alone. Of the rows with ``least_words`` words or more, ``percent`` in a hundred, rounded down, are drawn by the highest
    scores, ties to the smaller id, null ids last; rank counts them, and is null for others.

    Null and empty texts have no features and weight 0. Repeated rows are rows of their own; those that tie in score and id take their ranks in any order.
    Very long texts are read whole, in parts of ``SEGMENT`` words. Empty tables give an empty result, or gains against a target without
    features. Other columns are not read.
    """
    hashed = hashed_features(df, id_col, text_col, buckets, longest)
    gain = gains(bucket_counts(hashed, buckets), bucket_counts(hashed_features(target, None, target_text_col, buckets, longest), buckets))
    schema = T.StructType([*hashed.schema.fields[:3], T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 500):
            found, starts = _unpacked(batch.column(3), n := batch.column(2).to_numpy())
            weight = np.zeros(batch.num_rows, np.int64)
            if len(found):
                weight[n > 0] = np.add.reduceat(gain[found], starts[n > 0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], names=schema.names)

    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(first, 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(hashed.mapInArrow(run, schema).withColumn("score", F.col("weight") + noise), "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = ranked(able, able.count() * percent // 100)
    out = drawn.unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document, towards the texts of benchmark."""
    docs, goal = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, goal).select("doc_id", "n_features", "weight", "score", "rank")
