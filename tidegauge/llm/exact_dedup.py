"""Exact de-duplication with a two-pass Bloom filter, in DataFrame functions only.

Pass one hashes every normalised text and counts the filter cells that it sets; the cells set more than once
make the filter. Pass two probes the filter: rows with a cell that only they set can't have a copy and pass
straight through; the possibly repeated rest is grouped by the full hash, summed before it is shuffled, and joined with its groups.

The filter is split into blocks of 4 KB, a row's probes all lie in one block, and it reaches the rows by a
broadcast join on the block number. Its size is bounded by ``max_filter_bytes``: beyond some millions of rows per MB the
filter just lets more unrepeated rows through to the shuffle, and the result stays exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import broadcast_if_small, free_name, text_or_empty, written

BLOCK_BITS = 32768
#: Largest table of groups of copies that is sent to all executors, in rows of about 120 bytes; beyond, rows and groups are shuffled, and hot hashes split by Spark.
MOST_BROADCAST = 300_000
#: A run of white space, but for a lone blank, which stays as it is anyhow.
RUN = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(col: str) -> Column:
    """The text with each run of ASCII white space as one blank; null as empty."""
    return F.regexp_replace(text_or_empty(col), RUN, " ")


def _positions(sha: str, probes: int) -> list[Column]:
    return [F.xxhash64(F.col(sha), F.lit(i)).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(1, probes + 1)]


def repeat_filter(hashed: DataFrame, sha: str, blocks: int, probes: int) -> DataFrame:
    """(block, bits): a bitmap for each block with the cells that more than one row sets."""
    cells = hashed.select(_block(sha, blocks).alias("block"), F.explode(F.array_distinct(F.array(*_positions(sha, probes)))).alias("cell"))
    often = cells.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return often.groupBy("block").agg(F.bitmap_construct_agg("cell").alias("bits"))


def maybe_among(rows: DataFrame, keys: DataFrame, key: str, max_filter_bytes: int, bits_per_key: int = 16, probes: int = 2) -> DataFrame:
    """rows with a column maybe: false where their key is surely not in ``keys``, a written table; the filter's size is bounded, beyond it more are true."""
    blocks = max(1, min(max_filter_bytes * 8, keys.count() * bits_per_key) // BLOCK_BITS)
    cells = keys.select(_block(key, blocks).alias("block"), F.explode(F.array_distinct(F.array(*_positions(key, probes)))).alias("cell"))
    found = written(cells.groupBy("block").agg(F.bitmap_construct_agg("cell").alias("bits")), "filter")
    probed = rows.withColumn("block", _block(key, blocks)).join(F.broadcast(found), "block", "left")
    is_set = F.coalesce(reduce(lambda a, b: a & b, (_is_set("bits", at) for at in _positions(key, probes))), F.lit(False))
    return probed.withColumn("maybe", F.col(key).isNotNull() & is_set).drop("block", "bits")


def _block(sha: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(sha)), F.lit(blocks)).cast("int")


def _is_set(bits: str, at: Column) -> Column:
    """Whether a block's bitmap has a position."""
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.bit_get(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, probes: int = 2, max_filter_bytes: int = 64 << 20, carried: list[str] | None = None) -> DataFrame:
    """df, or those of its columns that are ``carried``, with keep_id, group_size, kept and text_sha256 (with underscores appended where df has such a column).

    Texts are equal when they are so after :func:`normalised`; null counts as empty. Of equal texts the row with the smallest id
    stays; null ids come last, and of rows that tie in the id, the one that is read first stays. An empty table
    gives an empty result. Very long texts are hashed whole. What is carried is written once, so texts are copied only where they are asked for.
    """
    carried = df.columns if carried is None else carried
    names = {x: free_name(df.columns, x) for x in ("keep_id", "group_size", "kept", "text_sha256", "row_no", "block", "bits")}
    sha, row, block, bits = names["text_sha256"], names["row_no"], names["block"], names["bits"]
    # written, for a second scan of df may be split otherwise and so number rows otherwise
    own = [F.col(f"`{c}`") for c in dict.fromkeys([id_col, *carried])]
    hashed = written(df.select(*own, F.sha2(normalised(f"`{text_col}`"), 256).alias(sha), F.monotonically_increasing_id().alias(row)), "hashed")
    blocks = max(1, min(max_filter_bytes * 8, hashed.count() * bits_per_row) // BLOCK_BITS)
    found = written(repeat_filter(hashed, sha, blocks, probes), "filter").select(F.col("block").alias(block), F.col("bits").alias(bits))
    probed = hashed.withColumn(block, _block(sha, blocks)).join(F.broadcast(found), block, "left")
    maybe = F.coalesce(reduce(lambda a, b: a & b, (_is_set(bits, at) for at in _positions(sha, probes))), F.lit(False))
    probed = probed.withColumn(bits, maybe)

    def result(rows: DataFrame, keep: Column, n: Column, kept: Column) -> DataFrame:
        return rows.select(*[F.col(f"`{c}`") for c in carried], keep.alias(names["keep_id"]), n.alias(names["group_size"]), kept.alias(names["kept"]), F.col(sha))

    alone = result(probed.filter(~F.col(bits)), F.col(f"`{id_col}`"), F.lit(1).cast("long"), F.lit(True))
    rest = probed.filter(F.col(bits)).drop(block, bits)
    first = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(row).alias("row"))
    groups = rest.groupBy(sha).agg(F.min(first).alias(block), F.count(F.lit(1)).alias(bits)).filter(F.col(bits) > 1)
    joined = rest.join(broadcast_if_small(written(groups, "copies"), MOST_BROADCAST), sha, "left")
    several = F.col(bits).isNotNull()
    keep = F.when(several, F.col(f"{block}.id")).otherwise(F.col(f"`{id_col}`"))
    return alone.unionByName(result(joined, keep, F.coalesce(F.col(bits), F.lit(1).cast("long")), ~several | (F.col(f"{block}.row") == F.col(row))))


def query(spark, sf_dir: str) -> DataFrame:
    """The digest of every row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, carried=["doc_id"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""
