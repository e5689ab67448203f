"""Substring de-duplication by sliding runs of consecutive sentences.

Sentences end with marks or lines, and every sentence is cut further by content: of each SPAN words in a row the one with the smallest
hash ends a piece. Whether a word does hangs on the SPAN - 1 words on either side alone, so a passage is cut alike in all texts but for its
edges, also where it stands within a sentence. Every run of exactly ``several`` consecutive pieces of a text is hashed; longer
repeated runs are covered by these. No piece has more than SPAN words, so whatever its host a passage of ``(several + 3) * SPAN - 2`` words
(48) holds a run, however long it is beyond that.

Hashes are made for whole slices of Arrow batches at once: words by prefix sums over the bytes, and runs from their words'.
A first pass counts the runs' digests, narrow rows that are summed before the shuffle; those that occur more
than once make a bitmap of bounded size. The second pass sends on only runs that the bitmap has, with their places; a join of these
with the first place of each digest leaves the non-first ones, and the pieces that those cover are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.shared import RepeatFilter, broadcast_if_small, in_byte_slices, text_or_empty, written

#: No piece has more words, and words of fewer than SHORT bytes end one only among their like: they are so common that they'd tell places badly.
SPAN, SHORT = 5, 4
#: Largest table of first places that is sent to all executors, in rows of about 100 bytes; beyond, both sides are shuffled, and hot runs split by Spark.
MOST_BROADCAST = 300_000

_U = np.uint64
#: Bytes hashed at once; words that are longer are hashed by themselves.
BLOCK = 1 << 20
_RNG = np.random.default_rng(10)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
#: Odd factors of words, and of both halves of a run's digest.
_FACTORS = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LINE = np.zeros(256, bool)
_LINE[[10, 13]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
CLOSERS = b"\"')]"
_CLOSER = np.zeros(256, bool)
_CLOSER[list(CLOSERS)] = True
#: Full stop, exclamation and question mark of texts that have no blanks: a word ends there too.
_WIDE = [np.frombuffer(x.encode(), np.uint8) for x in "。！？"]


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


def _mixed(x: np.ndarray, k: int = 0) -> np.ndarray:
    x = (x + _U(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(30))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_UP = _powers(_FACTORS[0], BLOCK)
_DOWN = _powers(pow(_FACTORS[0], -1, 1 << 64), BLOCK)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        own = data[low : int(ends[to - 1])]
        if len(own) > BLOCK:  # one word
            out[at] = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little")
        else:
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(_BYTE[own] * _UP[: len(own)], out=sums[1:])
            a, b = starts[at:to] - low, ends[at:to] - low
            out[at:to] = (sums[b] - sums[a]) * _DOWN[a]
        at = to
    return _mixed(out)


@dataclass
class Pieces:
    """The pieces of several texts: where each text's bytes start (and the last ends), and for each piece its text, its first byte and its words."""

    offsets: np.ndarray
    text: np.ndarray
    start: np.ndarray
    first: np.ndarray
    last: np.ndarray
    words: np.ndarray

    def runs(self, several: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The text, first piece (counted in the text) and two-number digest of every run of so many pieces."""
        n = max(0, len(self.text) - several + 1)
        k = np.flatnonzero(self.text[:n] == self.text[several - 1 :]) if n else np.zeros(0, np.int64)
        a, b = self.first[k], self.last[k + several - 1]
        halves = []
        for lane, factor in enumerate(_FACTORS[1:]):
            sums = np.zeros(len(self.words) + 1, np.uint64)
            np.cumsum(_mixed(self.words, lane) * _powers(factor, len(self.words)), out=sums[1:])
            halves.append(_mixed((sums[b] - sums[a]) * _powers(pow(factor, -1, 1 << 64), len(self.words))[a], lane).view(np.int64))
        own = self.text[k]
        return own, k - np.searchsorted(self.text, own), *halves


def pieces(texts: pa.Array) -> Pieces:
    """Cuts all texts of an array without nulls."""
    texts = texts.cast(pa.large_string())
    _, where, values = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None and len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
    n = len(data)
    solid = ~_SPACE[data]
    stop = np.zeros(n + 1, bool)  # a word ends before this byte, if it is solid too
    for mark in _WIDE:
        if n > 2 and (head := data[:-2] == mark[0]).any():
            stop[3:][head & (data[1:-1] == mark[1]) & (data[2:] == mark[2])] = True
    wide = np.flatnonzero(stop)
    stop[offsets] = True
    edge = np.zeros(n + 2, bool)
    edge[1:-1] = solid
    starts = np.flatnonzero(solid & (~edge[:n] | stop[:n]))
    ends = np.flatnonzero(solid & (~edge[2:] | stop[1:])) + 1
    count = len(starts)
    is_end = np.zeros(count + 1, bool)  # of the word before
    if count:
        tail = data[ends - 1]
        is_end[1:] = _STOP[tail]
        for i in np.flatnonzero(_CLOSER[tail]).tolist():
            is_end[i + 1] = data[starts[i] : ends[i]].tobytes().rstrip(CLOSERS)[-1:] in (b".", b"!", b"?")
        is_end[np.searchsorted(starts, np.flatnonzero(_LINE[data]))] = True
        is_end[np.searchsorted(starts, offsets)] = True
        is_end[np.searchsorted(starts, wide)] = True
    words = _hashed(data, starts, ends)
    if count >= SPAN:
        number = np.cumsum(is_end)  # of the sentence of each word
        keys = words & _U(0x7FFFFFFF00000000) | ((ends - starts) < SHORT).astype(np.uint64) << _U(63) | np.arange(count, 0, -1, dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            keys = np.minimum(keys[:-width], keys[width:])
            width *= 2
        least = np.minimum(keys[: count - SPAN + 1], keys[SPAN - width :])
        whole = number[: count - SPAN + 1] == number[SPAN - 1 : count]
        is_end[count + 1 - (least[whole] & _U(0xFFFFFFFF)).astype(np.int64)] = True
    is_end[0] = False
    last = np.flatnonzero(is_end)
    first = np.concatenate([np.zeros(1, np.int64), last[:-1]]) if len(last) else last
    start = starts[first]
    return Pieces(offsets, np.searchsorted(offsets, start, "right") - 1, start, first, last, words)


def dedup_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", several: int = 7, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """id, n_removed (pieces of sentences), n_chars_removed, removed (start:end of each stretch, code points, comma-joined) and clean, the text without them.

    A run's first place is in the row with the smallest id (null ids last, tied rows in the order they are read), and the first there; each
    other run of the same words is removed, whatever the white space between them. Runs in one text may overlap; then what is
    covered by any non-first one goes. Null counts as empty; texts without repeated runs, as are all of fewer than ``several`` pieces, stay
    as they are; repeated rows lose what they repeat. White space (ASCII) goes with the piece before it. An empty table gives an
    empty result, and further columns are not read. df is read once; long texts are cut whole.
    """
    spark = df.sparkSession
    # written, for a second scan of df may be split otherwise and so number rows otherwise
    numbered = written(df.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), text_or_empty(f"`{text_col}`").alias("text")), "numbered")

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_byte_slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(pieces(batch.column(0)).runs(several)[2])], names=["a"])

    # one half of the digest is enough for the bitmap, which may let more through
    counted = numbered.select("text").mapInArrow(every, "a long").groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    often_seen = written(counted.filter("n > 1").select("a", F.shiftright("a", 48).alias("b")), "runs")
    shared = spark.sparkContext.broadcast(RepeatFilter(often_seen, max_filter_bytes))
    place = T.StructType([T.StructField("id", df.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in ("row", "k", "a", "b"))])

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_byte_slices(batches, 2):
            text, k, a, b = pieces(batch.column(2)).runs(several)
            seen = np.flatnonzero(shared.value.among(a, a >> 48))
            at = pa.array(text[seen])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x[seen]) for x in (k, a, b))], names=place.names)

    places = written(numbered.mapInArrow(often, place), "places")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row", "k")
    first = places.groupBy("a", "b").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("often")).filter("often > 1").drop("often")
    first = broadcast_if_small(written(first, "firsts"), MOST_BROADCAST)
    later = places.join(first, ["a", "b"]).filter("row <> first.row or k <> first.k")
    covers = later.groupBy("row").agg(F.collect_set("k").alias("covers"))
    result = T.StructType([place["id"], T.StructField("n_removed", T.LongType()), T.StructField("n_chars_removed", T.LongType()), T.StructField("removed", T.StringType()), T.StructField("clean", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [removed(text, found, several) for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds))], names=result.names)

    return numbered.join(covers, "row", "left").select("id", "text", "covers").mapInArrow(cut, result).withColumnRenamed("id", id_col)


def removed(text: str, covers: list[int] | None, several: int) -> tuple[int, int, str, str]:
    """Pieces and characters removed, the stretches, and the rest; covers: the first pieces of the runs to remove."""
    if not covers:
        return 0, 0, "", text
    own = pieces(pa.array([text]))
    data = text.encode()
    starts = own.start.tolist()
    bounds = [0, *starts[1:], len(data)]
    gone = sorted({k for first in covers for k in range(first, first + several)})
    spans: list[list[int]] = []
    for k in gone:
        if spans and spans[-1][1] == bounds[k]:
            spans[-1][1] = bounds[k + 1]
        else:
            spans.append([bounds[k], bounds[k + 1]])
    rest, told, at, chars, taken = [], [], 0, 0, 0
    for a, b in spans:
        kept, cut_out = data[at:a].decode(), len(data[a:b].decode())
        rest.append(kept)
        chars += len(kept)
        told.append(f"{chars}:{chars + cut_out}")
        chars += cut_out
        taken += cut_out
        at = b
    return len(gone), taken, ",".join(told), "".join(rest) + data[at:].decode()


def query(spark, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat among them."""
    return dedup_sentences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
