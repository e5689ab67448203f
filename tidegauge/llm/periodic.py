"""Runs of periodic words in texts, by Lyndon arrays from the first phase of a grouping suffix sorter.

A run with exponent of two or more holds, under one of the two orders of words, a longest Lyndon word that begins in it and is as long as its period.
So the longest Lyndon words at all places, under both orders, are the candidates. Phase one of Baier's suffix sorter gives them: suffixes are grouped by first word, groups are taken
from the highest down, and the places before a group's suffixes are moved into new groups with longer prefixes; the prefix of a suffix's
last group is its longest Lyndon word. Each candidate is extended to both sides by longest common extensions, read from the ranks of all pieces of 1, 2, 4, ... words.

Runs of ``times`` periods or more hold each of their words at least ``times`` times. So places whose word is rarer, first in its text, then in the stretch
between such places, are left out before, and so are stretches shorter than the shortest run: no run of that kind is lost, and most of usual texts goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.shared import free_name, in_byte_slices, in_slices
from tidegauge.llm.spans import Words, words_of

_BYTE = np.arange(256)
#: Bytes of words: all but white space of ASCII.
IS_WORD = ~((_BYTE == 0x20) | (_BYTE >= 0x09) & (_BYTE <= 0x0D))
#: The same as a pattern of one word.
WORD = r"([^\x20\x09-\x0D]+)"


def lyndon_lengths(s: list[int]) -> list[int]:
    """The length of the longest Lyndon word at each place of s, by grouping suffixes; the end counts as smaller than all symbols."""
    n = len(s)
    symbols = {x: g for g, x in enumerate(sorted(set(s)))}
    group = [symbols[x] for x in s]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    prefix = [1] * len(members)  # length of what all suffixes of a group begin with
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    before, done, length = [-1] * n, bytearray(n), [1] * n
    g = len(members) - 1
    while g != -1:
        own, u = [i for i in members[g] if group[i] == g], prefix[g]
        for i in own:
            done[i] = 1
            length[i] = u
        moved: dict[tuple[int, int], list[int]] = {}
        last, times = -1, 0
        for i in own:  # ascending, so that the places before them ascend too
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i] = j
            if j == last:
                times += 1
                continue
            if last >= 0:
                moved.setdefault((group[last], times), []).append(last)
            last, times = j, 1
        if last >= 0:
            moved.setdefault((group[last], times), []).append(last)
        for old, k in sorted(moved, key=lambda x: -x[1]) if len(moved) > 1 else moved:
            new, places = len(members), moved[old, k]
            members.append(places)
            prefix.append(prefix[old] + k * u)
            top = above[old]
            below.append(old)
            above.append(top)
            above[old] = new
            below[top] = new  # there is one: the group at hand is higher
            for j in places:
                group[j] = new
        g = below[g]
    return length


@dataclass
class Extensions:
    """Longest common extensions of places of s to either side, from the ranks of pieces of 1, 2, 4, ... symbols."""

    ranks: list[np.ndarray]

    @classmethod
    def of(cls, s: np.ndarray, longest: int) -> Extensions:
        """longest: no extension is asked to reach further."""
        ranks, size = [s.astype(np.int64)], 1
        while 2 * size <= min(longest, len(s)):
            a = ranks[-1]
            pair = a[: len(a) - size] * (a.max() + 1) + a[size:]
            ranks.append(pa.array(pair).dictionary_encode().indices.to_numpy().astype(np.int64))
            size *= 2
        return cls(ranks)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a and from b on are the same; a < b."""
        a, b, start = a.copy(), b.copy(), a
        for k in range(len(self.ranks) - 1, -1, -1):
            r = self.ranks[k]
            same = np.flatnonzero(b < len(r))
            same = same[r[a[same]] == r[b[same]]]
            a[same] += 1 << k
            b[same] += 1 << k
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before a and before b are the same."""
        a, b, start = a.copy(), b.copy(), a
        for k in range(len(self.ranks) - 1, -1, -1):
            r, size = self.ranks[k], 1 << k
            same = np.flatnonzero(a >= size)
            same = same[r[a[same] - size] == r[b[same] - size]]
            a[same] -= size
            b[same] -= size
        return start - a


def stretches(text: np.ndarray, code: np.ndarray, many: int, least: int, times: int, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(place, stretch): the places of words that may lie in a run, and the number of the stretch of neighbours that each belongs to."""
    place, part = np.arange(len(text)), text
    for _ in range(rounds):
        if not len(place):
            break
        own = pa.array(part * many + code[place]).dictionary_encode().indices.to_numpy()
        often = np.bincount(own)[own] >= times
        kept, side = place[often], part[often]
        part = np.cumsum(np.concatenate([[1], (np.diff(kept) > 1) | (np.diff(side) != 0)])) if len(kept) else side
        long = np.bincount(part)[part] >= least if len(part) else np.zeros(0, bool)
        end = len(kept[long]) == len(place)
        place, part = kept[long], part[long]
        if end:
            break
    return place, part


def runs_in(place: np.ndarray, part: np.ndarray, code: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs within stretches, as places of words, by start, then period."""
    if not len(place):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.diff(part, prepend=-1))
    sizes = np.diff(np.append(first, len(part)))
    s = np.unique(code[place], return_inverse=True)[1]
    # each stretch ends with a symbol of its own, so no extension leaves it
    shift = np.repeat(np.arange(len(sizes)), sizes)
    joined = np.empty(len(s) + len(sizes), np.int64)
    joined[np.arange(len(s)) + shift] = s
    joined[np.cumsum(sizes) + np.arange(len(sizes))] = s.max() + 1 + np.arange(len(sizes))
    lengths = np.zeros((2, len(s)), np.int64)
    for a, n in zip(first.tolist(), sizes.tolist(), strict=True):
        own = s[a : a + n]
        lengths[0, a : a + n] = lyndon_lengths(own.tolist())
        lengths[1, a : a + n] = lyndon_lengths((-own).tolist())
    room = np.repeat(sizes, sizes) // times
    which, at = np.nonzero(lengths <= room)
    period = lengths[which, at]
    at, period = np.unique(np.stack([at, period]), axis=1)
    same = Extensions.of(joined, int(sizes.max()))
    i = at + shift[at]
    back = same.backward(i, i + period)
    start, length = at - back, back + period + same.forward(i, i + period)
    real = length >= np.maximum(least, times * period)
    found = np.unique(np.stack([start[real], period[real], length[real]]), axis=1)
    return place[found[0]], found[2], found[1]


def collapsed(words: Words, kept: np.ndarray, count: int) -> pa.Array:
    """The kept words of each of so many texts, joined by single blanks."""
    sizes, text = words.sizes[kept], words.text[kept]
    own = Words(words.data[np.repeat(kept, words.sizes)], np.cumsum(sizes), text)
    data, starts = own.joined()
    last = np.flatnonzero(np.append(text[1:] != text[:-1], True)) if len(text) else np.zeros(0, np.int64)
    data = np.delete(data, starts[last] + sizes[last])
    bytes_ = np.bincount(text, sizes + 1, count).astype(np.int64) - (np.bincount(text, minlength=count) > 0)
    offsets = np.concatenate([[0], np.cumsum(bytes_)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), count, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())


RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])


def _of_texts(texts: pa.Array, least: int, times: int) -> tuple[list[list[dict]], pa.Array]:
    """The runs of each text, and what is left of it when they are collapsed."""
    words = words_of(texts, IS_WORD)
    code, many = words.codes()
    place, part = stretches(words.text, code, many, least, times)
    start, length, period = runs_in(place, part, code, least, times)
    change = np.zeros(len(code) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    first = np.searchsorted(words.text, np.arange(len(texts)))
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for a, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
        own = int(words.text[a])
        out[own].append({"start": a - int(first[own]), "length": n, "period": p})
    return out, collapsed(words, np.cumsum(change[:-1]) == 0, len(texts))


def _strongest(runs: list[dict]) -> dict | None:
    """The run with the greatest length by period, exactly; ties to the first."""
    best = None
    for r in runs:
        if best is None or r["length"] * best["period"] > best["length"] * r["period"]:
            best = r
    return best


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """id, runs, strongest and collapsed of every row of df.

    Words are what stands between ASCII white space. A run is a stretch of consecutive words with smallest period q that has ``least`` words or
    more and ``times`` periods or more (two at least), and that no neighbouring word extends. runs: start (word number, from 0), length and period, by start,
    then period. strongest: the run with the greatest length by period, ties to the smaller start, then period; null without runs. collapsed: the
    words that no run holds after its first q words, joined by single blanks.

    Null and empty texts, and texts of white space, have no runs and collapse to an empty text. Very long texts are searched whole. Rows are told one by one, so repeated
    rows and null ids make no difference, nothing is shuffled, other columns are not read, and an empty table gives an empty result.
    """
    if times < 2 or least < 1:
        raise ValueError("runs have two periods and one word at least")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("runs", T.ArrayType(RUN)), T.StructField("strongest", RUN), T.StructField("collapsed", T.StringType())])
    kind = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_byte_slices(in_slices(batches, 5000), 1):
            runs, left = _of_texts(batch.column(1), least, times)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(kind)), pa.array(list(map(_strongest, runs)), kind), left], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def with_periodic_tails(df: DataFrame, id_col: str, text_col: str, every: int = 10) -> DataFrame:
    """df, but for one row in ``every``, by a checksum of its id, its words from a place on are repeated with a period of at most a third of them.

    With h the checksum of the id as text and g = h div every, the tail begins at word g mod n and its period is one more than its length div
    (3 + g mod 8). Null ids and texts without words stay as they are.
    """
    h, g, words = (free_name(df.columns, x) for x in ("_h", "_g", "_words"))
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.withColumn(h, F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))).withColumn(g, F.floor(F.col(h) / every).cast("long"))
    rows = rows.withColumn(words, F.when(F.col(h) % every == 0, F.regexp_extract_all(text, F.lit(WORD), F.lit(1))))
    n = F.nullif(F.size(words).cast("long"), F.lit(0))
    a = F.col(g) % n
    p = 1 + F.floor((n - a) / (3 + F.col(g) % 8)).cast("long")
    head, cycle = F.slice(words, F.lit(1), a.cast("int")), F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return rows.withColumn(text_col, F.coalesce(F.when(F.size(words) > 0, F.array_join(F.concat(head, tail), " ")), text)).drop(h, g, words)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document, one in ten with a periodic tail."""
    docs = with_periodic_tails(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text")
    best = [F.col(f"strongest.{x}").alias(x) for x in ("start", "length", "period")]
    milli = F.floor(1000 * F.col("strongest.length") / F.col("strongest.period")).alias("exponent_milli")
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    digests = [F.sha2(c.cast("binary"), 256).alias(x) for c, x in ((told, "runs_sha256"), (F.col("collapsed"), "collapsed_sha256"))]
    return periodic_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, *digests)
