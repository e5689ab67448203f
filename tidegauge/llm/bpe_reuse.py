"""Byte-level BPE with content-defined chunks that documents share encoded once.

A rolling hash cuts every text into chunks where its content says so, so equal passages give equal chunks. A first pass counts the chunks'
digests; those that occur more than once make a bitmap of bounded size. In the second pass, a document without such chunks
is encoded where it is read. Of the others, each repeated chunk goes by its digest to be encoded once, and its
ids come back by a join. Where chunks meet, the text between the nearest safe points on either side is encoded anew: there
the ids agree with those of the whole text, because no token crosses a safe point and nothing beyond it
changes the tokens on its other side. A chunk without a safe point is encoded anew together with what is around it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidegauge.llm.shared import RepeatFilter, digest, in_slices, text_or_empty, written
from tidegauge.llm.words import UNUSUAL

#: Fixed value: the one special token of the vocabulary.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: A blank after a printable ASCII character: a token always starts there.
SAFE = re.compile(rb"(?<=[!-~])\x20")
#: A run of white space that the fast encoder's patterns can't take; the tokenizers library can.
LONG_RUN = re.compile(r"(?<!\s)\s{50000,}+")
WINDOW, LEAST, MEAN, MOST = 16, 256, 1024, 8192
_TABLE = np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.uint64)
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, 2**k, 2**64)) for k in range(4)]


class ByteEncoder:
    """Texts to ids as the tokenizers library gives them; the same vocabulary as ranks does it faster for usual characters."""

    def __init__(self, path: str, ranks_path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (SPECIAL_ID + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.bytes[SPECIAL_ID] = SPECIAL.encode()
        self.lengths = np.array(list(map(len, self.bytes)), np.int64)
        self.decimal = [str(i) for i in range(SPECIAL_ID + 1)]

    def __call__(self, text: str) -> list[int]:
        if UNUSUAL.search(text) or len(text) >= 50_000 and LONG_RUN.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if SPECIAL not in text:
            return self.fast.encode_ordinary(text)
        out: list[int] = []
        for k, part in enumerate(text.split(SPECIAL)):
            out += [SPECIAL_ID] * (k > 0) + self.fast.encode_ordinary(part)
        return out

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        """Number of ids, and the digests of the ids in decimal and of the decoded text."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        listed = ",".join(map(self.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    def joined(self, parts: list[tuple[bytes, list[int] | None]]) -> list[int]:
        """The ids of a text from those of its parts; None: not encoded yet."""
        out: list[int] = []
        open_ = b""
        for data, ids in parts:
            inner = self._inner(data, ids)
            if inner is None:
                open_ += data
                continue
            head, tail, ids = inner
            out += self((open_ + data[:head]).decode())
            out += ids
            open_ = data[tail:]
        return out + self(open_.decode())

    def _inner(self, data: bytes, ids: list[int] | None) -> tuple[int, int, list[int]] | None:
        """The first and last safe point of a part, and the ids between them; None if it has none, or if its ids have no token that starts there."""
        points = [m.start() for m in SAFE.finditer(data)]
        if not points:
            return None
        head, tail = points[0], points[-1]
        if ids is None:
            return head, tail, self(data[head:tail].decode())
        ends = np.cumsum(self.lengths[ids])
        a, b = np.searchsorted(ends, (head, tail))
        if ends[a] != head or ends[b] != tail:
            return None
        return head, tail, ids[a + 1 : b + 1]


@functools.cache
def encoder(path: str, ranks_path: str) -> ByteEncoder:
    """One encoder for each worker and file."""
    return ByteEncoder(path, ranks_path)


def cuts(data: bytes) -> list[int]:
    """Where the chunks of a text end: at UTF-8 character starts at which the hash of the last bytes says so, at least LEAST and at most MOST bytes apart."""
    n = len(data)
    if n <= LEAST:
        return [n]
    b = np.frombuffer(data, np.uint8)
    h = _TABLE[b]
    for k, factor in enumerate(_FACTORS):
        h = h[: -(1 << k)] * factor + h[1 << k :]
    at = np.flatnonzero((h >> np.uint64(40)) % np.uint64(MEAN - LEAST) == 0) + WINDOW  # the window ends before this byte
    at = at[at < n]
    at = at[(b[at] & 0xC0) != 0x80]
    out, last = [], 0
    for p in [*at.tolist(), n]:
        while p - last > MOST:
            last += MOST
            while data[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if p - last >= LEAST or p == n:
            out.append(p)
            last = p
    return out


def chunks(data: bytes) -> list[bytes]:
    """The chunks of a text."""
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def repeated_chunks(df: DataFrame, text_col: str, max_filter_bytes: int) -> RepeatFilter:
    """Which chunks may occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(c) for cell in batch.column(0) for c in chunks(cell.as_py().encode())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    every = df.select(text_or_empty(f"`{text_col}`")).mapInArrow(run, "a long, b long")
    often = every.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b")
    return RepeatFilter(written(often, "chunks"), max_filter_bytes)


def encode_documents(df: DataFrame, tokenizer: str | None = None, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = 32 << 20, with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every text; with_ids also gives the ids, little-endian unsigned 32-bit.

    Null counts as empty and gives no ids. Repeated rows give repeated results, null ids stay null, further columns are not read,
    an empty table gives an empty result, and texts are encoded whole, however long, as are their words and runs of white space.
    """
    spark = df.sparkSession
    path, ranks_path = tokenizer or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    shared = spark.sparkContext.broadcast(repeated_chunks(df, text_col, max_filter_bytes))
    done = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] + [T.StructField("ids", T.BinaryType())] * with_ids
    result = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *done])
    part = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("data", T.BinaryType())])
    first = T.StructType([*result.fields, T.StructField("row", T.LongType()), T.StructField("parts", T.ArrayType(part))])
    part_kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("data", pa.binary())]))

    def columns(encode: ByteEncoder, every: list[list[int] | None]) -> list[pa.Array]:
        """The result's columns after the id."""
        found = [encode.digests(ids) if ids is not None else (None,) * 3 for ids in every]
        out = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
        return out + [pa.array([None if ids is None else np.array(ids, "<u4").tobytes() for ids in every], pa.binary())] * with_ids

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Encodes texts without repeated chunks; the others in parts, with the digest of each that is repeated."""
        encode, repeated, press = encoder(path, ranks_path), shared.value, zstandard.ZstdCompressor(6)
        for batch in in_slices(batches):
            every, parts = [], []
            for cell in batch.column(1):
                text = cell.as_py()
                own: list[dict] = []
                for c in chunks(text.encode()):
                    a, b = digest(c)
                    if (a, b) in repeated:
                        own.append({"a": a, "b": b, "data": c})
                    elif own and own[-1]["a"] is None:
                        own[-1]["data"] += c
                    else:
                        own.append({"a": None, "b": None, "data": c})
                alone = all(x["a"] is None for x in own)
                for x in own * (not alone):
                    x["data"] = press.compress(x["data"])
                every.append(encode(text) if alone else None)
                parts.append(None if alone else own)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(encode, every), batch.column(2), pa.array(parts, part_kind)], names=first.names)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, press, unpress = encoder(path, ranks_path), zstandard.ZstdCompressor(6), zstandard.ZstdDecompressor().decompress
        for batch in in_slices(batches):
            ids = [press.compress(np.array(encode(unpress(x.as_py()).decode()), "<u2").tobytes()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["a", "b", "ids"])

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, unpress = encoder(path, ranks_path), zstandard.ZstdDecompressor().decompress
        for batch in in_slices(batches):
            every = []
            for own, got in zip(batch.column(1), batch.column(2), strict=True):
                known = {x["k"]: np.frombuffer(unpress(x["ids"]), "<u2").tolist() for x in got.as_py()}
                every.append(encode.joined([(b"".join(map(encode.bytes.__getitem__, known[k])), known[k]) if x is None else (unpress(x), None) for k, x in enumerate(own.as_py())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(encode, every)], names=result.names)

    rows = df.select(F.col(f"`{id_col}`").alias(id_col), text_or_empty(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows.mapInArrow(split, first), "encoded")
    waiting = rows.filter("parts is not null")
    refs = waiting.select("row", F.posexplode("parts").alias("k", "part")).select("row", "k", "part.*").filter("a is not null")
    distinct = refs.groupBy("a", "b").agg(F.first("data").alias("data"))
    known = distinct.mapInArrow(once, "a long, b long, ids binary")
    back = refs.drop("data").join(known, ["a", "b"]).groupBy("row").agg(F.collect_list(F.struct("k", "ids")).alias("known"))
    unknown = F.transform("parts", lambda x: F.when(x["a"].isNull(), x["data"])).alias("parts")
    mended_rows = waiting.select(id_col, "row", unknown).join(back, "row").select(id_col, "parts", "known").mapInArrow(mended, result)
    return rows.filter("parts is null").select(*result.names).unionByName(mended_rows)


def query(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
