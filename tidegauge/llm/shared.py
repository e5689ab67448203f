"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset (tests), a folder of this application."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(table: DataFrame, most_rows: int) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has at most so many; else joins shuffle it."""
    return F.broadcast(table) if table.count() <= most_rows else table


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that what a task makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_byte_slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts, of the column at ``text``, have so many bytes, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_or_empty(col: str):
    """Null texts count as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def free_name(taken: list[str], wanted: str) -> str:
    """wanted, or wanted with underscores until it clashes with no column."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


BLOCK_BITS = 32768


class RepeatFilter:
    """Bitmaps of bounded size over pairs of numbers that are hashes: whether a pair may be among those given."""

    def __init__(self, pairs: DataFrame, max_bytes: int):
        """pairs: a written table with columns a and b. At most max_bytes come to the driver."""
        self.blocks = max(1, min(max_bytes * 8, pairs.count() * 16) // BLOCK_BITS)
        cells = pairs.select(F.pmod("a", F.lit(self.blocks)).alias("block"), F.col("b").bitwiseAND(F.lit(BLOCK_BITS - 1)).alias("cell"))
        rows = cells.groupBy("block").agg(F.bitmap_construct_agg("cell").alias("bits")).collect()
        size = BLOCK_BITS // 8
        self.bits = bytearray(self.blocks * size)
        for r in rows:
            self.bits[r["block"] * size : (r["block"] + 1) * size] = r["bits"]

    def __contains__(self, pair: tuple[int, int]) -> bool:
        at = pair[0] % self.blocks * BLOCK_BITS + (pair[1] & (BLOCK_BITS - 1))
        return bool(self.bits[at >> 3] >> (at & 7) & 1)

    def among(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same for arrays of signed numbers."""
        at = a % self.blocks * BLOCK_BITS + (b & (BLOCK_BITS - 1))
        return (np.frombuffer(self.bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def digest(data: bytes) -> tuple[int, int]:
    """128 bits of a hash as two signed numbers."""
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
