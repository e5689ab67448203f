"""Toxicity by the nearest labelled examples.

Terms are words. All that two labelled texts share make the vocabulary. A term's weight is its inverse
document frequency, counted over all documents, times the log-likelihood ratio by which it tells toxic examples from others. Labelled
examples are indexed by term, in blocks of examples with the largest weight of each term in each block: a posting list a block for each term, and
for the few terms with the longest lists a dense row. For a document, blocks are taken by descending upper bound of the cosine, and a document is
done when the next bound is below its k-th best score, so its neighbours are exact. Their votes are weighted by distance; a
logistic curve, fitted on the examples' own left-out votes, makes scores of them, and the neighbours are the evidence.

What is learnt from labels is learnt from at most ``max_labelled`` distinct labelled texts, half of them of either label, taken in the order of
a hash of the text; at most ``max_examples`` of them, half of either label too, are indexed. Documents are scored where they are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.shared import in_byte_slices, in_slices, text_or_empty, written

WORD = re.compile(r"[^\W_]+")
BLOCK = 64
#: Most documents scored at once, and fewer where they are long.
SLICE = 500
#: Added to a neighbour's distance before it divides its vote; weight of the prior among the votes.
NEAR, PRIOR = 0.05, 0.5


@dataclass
class Rows:
    """Sparse rows: where each starts (and the last ends), and the terms and weights of all, in the order of terms."""

    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def of(self, own: np.ndarray) -> Rows:
        """Some of the rows."""
        sizes = np.diff(self.starts)[own]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[own] - starts[:-1], sizes) + np.arange(starts[-1])
        return Rows(starts, self.terms[at], self.weights[at])

    def times(self, table: np.ndarray) -> np.ndarray:
        """The rows times a table by term."""
        out = np.zeros((len(self.starts) - 1, table.shape[1]), np.float32)
        some = np.flatnonzero(np.diff(self.starts))
        if len(some):
            out[some] = np.add.reduceat(table[self.terms] * self.weights[:, None], self.starts[some], axis=0)
        return out


def rows_of(counts: list[dict], weight: np.ndarray) -> Rows:
    """Rows of unit length: (1 + ln count) * weight."""
    sizes = np.array([len(x) for x in counts], np.int64)
    terms = np.fromiter((t for x in counts for t in x), np.int64, sizes.sum())
    n = np.fromiter((v for x in counts for v in x.values()), np.int64, sizes.sum())
    return _unit(np.repeat(np.arange(len(counts)), sizes), terms, n, len(counts), weight)


def rows_of_texts(texts: list[str], at: dict[str, int], weight: np.ndarray) -> Rows:
    """The same from texts; at: the terms with their numbers."""
    words = [Counter(WORD.findall(text.lower())) for text in texts]
    sizes = np.array([len(c) for c in words], np.int64)
    terms = np.fromiter((at.get(w, -1) for c in words for w in c), np.int64, sizes.sum())
    n = np.fromiter((v for c in words for v in c.values()), np.int64, sizes.sum())
    known = terms >= 0
    return _unit(np.repeat(np.arange(len(texts)), sizes)[known], terms[known], n[known], len(texts), weight)


def _unit(row: np.ndarray, terms: np.ndarray, n: np.ndarray, count: int, weight: np.ndarray) -> Rows:
    """Rows from their terms' counts, which may come in parts; rows are in order."""
    key = row * max(1, len(weight)) + terms
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.add.reduceat(n[order], first) if len(key) else n
    row, terms = row[order][first], terms[order][first]
    w = (1 + np.log(n)) * weight[terms]
    norm = np.sqrt(np.bincount(row, w * w, count))
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=count))])
    return Rows(starts, terms, (w / np.where(norm > 0, norm, 1)[row]).astype(np.float32))


@dataclass
class Index:
    """Examples in blocks of BLOCK: posting lists by term, the largest weight of each term in each block, and what the examples are.

    dense: the terms that have rows in ``common`` (terms x examples), with those rows' numbers, -1 for none. Any other term has a posting list in each block:
    that of term t in block b lies between ``starts`` b * terms + t and the next one.
    """

    largest: np.ndarray
    dense: np.ndarray
    common: np.ndarray
    starts: np.ndarray
    example: np.ndarray
    posted: np.ndarray
    toxic: np.ndarray
    ids: list
    rate: float
    weight: np.ndarray
    texts: dict[bytes, int]
    curve: tuple[float, float] = (1.0, 0.0)

    def own(self, texts: list[str]) -> np.ndarray:
        """The example with each text, -1 for none: a text's own label is no vote on it."""
        return np.array([self.texts.get(text_digest(t), -1) for t in texts], np.int64)

    def neighbours(self, q: Rows, k: int, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, examples), k for each row of q, best first; leave: an example to leave out for each row, -1 for none. Ties go to the smaller example.

        The two blocks with the largest bounds are scored first. Then, of the others, those whose bound is not below the k-th best score: no other
        can hold a neighbour, and no posting or dense weight of another is read.
        """
        count, n = len(q.starts) - 1, len(self.toxic)
        best, who = np.zeros((count, k), np.float32), np.full((count, k), n, np.int64)
        if not n or not count:
            return best, who
        usual, rare = self.parted(q)
        bound = (usual @ self.largest[np.flatnonzero(self.dense >= 0)] + rare.times(self.largest)) * np.float32(1.0001)
        s = np.zeros((count, n), np.float32)

        def score(wanted: np.ndarray) -> None:
            for block in np.flatnonzero(wanted.any(axis=0)).tolist():
                rows = np.flatnonzero(wanted[:, block])
                s[rows, block * BLOCK : (block + 1) * BLOCK] = self.scored(block, usual[rows], rare.of(rows))
            if leave is not None:
                s[np.flatnonzero(leave >= 0), leave[leave >= 0]] = 0

        wanted = np.zeros(bound.shape, bool)
        np.put_along_axis(wanted, np.argsort(-bound, axis=1, kind="stable")[:, :2], True, axis=1)
        score(wanted)
        if bound.shape[1] > 2:
            least = np.partition(s, n - k, axis=1)[:, n - k] if n >= k else np.zeros(count, np.float32)
            score((bound > 0) & (bound >= least[:, None]) & ~wanted)
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        best[:, : top.shape[1]] = np.take_along_axis(s, top, 1)
        who[:, : top.shape[1]] = top
        return best, np.where(best > 0, who, n)

    def parted(self, q: Rows) -> tuple[np.ndarray, Rows]:
        """The rows' weights in dense terms, and the rows in the others."""
        count = len(q.starts) - 1
        row, at = np.repeat(np.arange(count), np.diff(q.starts)), self.dense[q.terms]
        usual = np.zeros((count, len(self.common)), np.float32)
        usual[row[at >= 0], at[at >= 0]] = q.weights[at >= 0]
        few = at < 0
        return usual, Rows(np.concatenate([[0], np.cumsum(np.bincount(row[few], minlength=count))]), q.terms[few], q.weights[few])

    def scored(self, block: int, usual: np.ndarray, rare: Rows) -> np.ndarray:
        """The scores of one block's examples, a row for each of the given ones: their weights in dense terms, and what they have in others. Reads that block's postings only."""
        low, width = block * BLOCK, min(BLOCK, len(self.toxic) - block * BLOCK)
        of = block * len(self.weight) + rare.terms
        first, sizes = self.starts[of], self.starts[of + 1] - self.starts[of]
        ends = np.cumsum(sizes)
        place = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        row = np.repeat(np.repeat(np.arange(len(usual)), np.diff(rare.starts)), sizes)
        value = self.posted[place] * np.repeat(rare.weights, sizes)
        few = np.bincount(row * width + self.example[place] - low, value, len(usual) * width).reshape(len(usual), width)
        return few.astype(np.float32) + usual @ self.common[:, low : low + width]

    def votes(self, best: np.ndarray, who: np.ndarray) -> np.ndarray:
        """The share of toxic votes, each weighted by its distance, with the prior's vote."""
        w = np.where(best > 0, 1 / (1 - np.minimum(best, 1) + NEAR), 0).astype(np.float64)
        y = np.append(self.toxic, 0)[who]
        return ((w * y).sum(1) + PRIOR * self.rate) / (w.sum(1) + PRIOR)

    def score(self, votes: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * _logit(votes) + b)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fitted(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps; a small penalty holds the slope finite."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(w * (p - y) * x).sum() + 0.5 * a, (w * (p - y)).sum()])
        v = w * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * x * x).sum() + 0.5, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def held_out(id_col: str):
    """Whether the checksum of the id as text is a multiple of five; never for null ids."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(texts: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """(id, hash, toxic) of at most ``most`` distinct texts with labels that aren't held out, half of either label.

    An id with two labels counts as toxic, and so does a text; of rows that share a text the smallest id stands for it. Only ids and hashes are shuffled.
    """
    usable = labels.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isin(0, 1) & ~held_out(id_col))
    usable = usable.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("toxic"))
    own = texts.select("id", "hash").join(usable, "id").groupBy("hash").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic"))
    halves = [own.filter(F.col("toxic") == y).orderBy(F.xxhash64("hash"), "hash").limit(most // 2) for y in (0, 1)]
    return halves[0].unionByName(halves[1])


def vocabulary(texts: DataFrame, sample: DataFrame) -> tuple[dict[str, int], np.ndarray, float]:
    """The terms that two or more texts of the sample share, with the log-likelihood ratio by which each tells the toxic from the others; and the share of toxic ones.

    A term counts once for each text, and texts in which it first stands between the same words count once, so near copies don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = ["", *WORD.findall(cell.as_py().lower()), ""]
                seen: dict[str, int] = {}
                for before, word, after in zip(words, words[1:-1], words[2:], strict=False):
                    if word not in seen:
                        seen[word] = crc32(f"{before} {word} {after}".encode())
                seen[""] = crc32(cell.as_py().encode())
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([toxic] * len(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["term", "toxic", "around"])

    every = texts.join(F.broadcast(sample.select("id", "hash", "toxic")), ["id", "hash"]).select("text", "toxic").mapInArrow(run, "term string, toxic int, around long").distinct()
    counts = every.groupBy("term").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b")).filter("a + b >= 2")
    found = counts.toArrow().sort_by("term")  # a row a term of the sample, that of the empty term, which counts the texts, first
    if not found.num_rows or found["term"][0].as_py() or not found["a"][0].as_py() or not found["b"][0].as_py():
        return {}, np.zeros(0), 0.1
    pos, neg = found["a"][0].as_py(), found["b"][0].as_py()
    found = found.slice(1)
    a, b = (found[c].to_numpy() for c in ("a", "b"))

    def part(x: np.ndarray, n: np.ndarray) -> np.ndarray:  # of one cell of the table of a term's presence
        x = np.maximum(x, 0)
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) * (pos + neg) / np.maximum(n, 1e-300)), 0)

    rest = np.maximum(pos + neg - a - b, 0)
    ratio = 2 * (part(a, (a + b) * pos) + part(b, (a + b) * neg) + part(pos - a, rest * pos) + part(neg - b, rest * neg))
    return {t: i for i, t in enumerate(found["term"].to_pylist())}, np.maximum(ratio, 0), pos / (pos + neg)


def document_frequencies(texts: DataFrame, shared: Broadcast, count: int) -> tuple[int, np.ndarray]:
    """The number of texts, and how many of them have each of so many terms; tasks send on sums. shared: the terms with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = shared.value, 0
        seen = np.zeros(len(at) + 1, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                own = set(WORD.findall(cell.as_py().lower()))
                seen[np.fromiter((at.get(w, -1) for w in own), np.int64, len(own))] += 1  # each once but for -1, which is no term
            n += batch.num_rows
        seen[-1] = 0
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], n))], names=["t", "n"])

    sums = texts.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a row a term
    out = np.zeros(count + 1)
    out[sums["t"].to_numpy()] = sums["n"].to_numpy()  # the number of texts is under -1, the last place
    return int(out[-1]), out[:-1]


#: Terms with the longest posting lists, which have dense rows.
COMMON = 512


def text_digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def build_index(x: Rows, toxic: list[int], ids: list, weight: np.ndarray, rate: float, k: int, texts: list[bytes] | None = None) -> Index:
    """x: the examples' rows; texts: their digests, by which :meth:`Index.own` finds them."""
    row = np.repeat(np.arange(len(ids)), np.diff(x.starts))
    top = np.zeros(len(ids), np.int64)
    if len(row):  # the heaviest term of each, by which like ones are put together
        by = np.lexsort((x.weights, row))
        last = x.starts[1:][np.diff(x.starts) > 0] - 1
        top[row[by][last]] = x.terms[by][last]
    order = np.lexsort((np.arange(len(ids)), top, toxic)) if len(ids) else np.zeros(0, np.int64)
    x, y, ids = x.of(order), np.array(toxic, np.int64)[order], [ids[i] for i in order]
    row = np.repeat(np.arange(len(ids)), np.diff(x.starts))
    often = np.bincount(x.terms, minlength=len(weight))
    usual = np.sort(np.argsort(-often, kind="stable")[:COMMON])
    dense = np.full(len(weight), -1, np.int64)
    dense[usual] = np.arange(len(usual))
    common = np.zeros((len(usual), len(ids)), np.float32)
    own = dense[x.terms] >= 0
    common[dense[x.terms[own]], row[own]] = x.weights[own]
    blocks = -(-len(ids) // BLOCK)
    largest = np.zeros((len(weight), blocks), np.float32)
    np.maximum.at(largest, (x.terms, row // BLOCK), x.weights)
    lists = row // BLOCK * len(weight) + x.terms
    by = np.flatnonzero(~own)[np.argsort(lists[~own], kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(lists[by], minlength=blocks * len(weight)))]).astype(np.int64)
    index = Index(largest, dense, common, starts, row[by].astype(np.int32), x.weights[by], y, ids, rate, weight, {texts[j]: i for i, j in enumerate(order.tolist())} if texts else {})
    if 0 < y.sum() < len(y):
        parts = [np.arange(at, min(at + BLOCK, len(y))) for at in range(0, len(y), BLOCK)]
        votes = np.concatenate([index.votes(*index.neighbours(x.of(own), k, own)) for own in parts])
        share = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
        index.curve = fitted(_logit(votes), y, share)
    return index


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("text"))


def _learnt(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, k: int, max_labelled: int, max_examples: int) -> tuple[dict[str, int], Index]:
    """The vocabulary and the index of examples."""
    texts = _texts(df, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    sample = written(labelled_sample(texts, labels, id_col, label_col, max_labelled), "sample")
    at, ratio, rate = vocabulary(texts, sample)
    shared = df.sparkSession.sparkContext.broadcast(at)
    n, seen = document_frequencies(texts, shared, len(at))
    weight = np.log((1 + n) / (1 + seen)) * ratio
    halves = [sample.filter(F.col("toxic") == y).orderBy(F.xxhash64("hash", F.lit(1)), "hash").limit(max_examples // 2) for y in (0, 1)]
    own = texts.join(F.broadcast(halves[0].unionByName(halves[1])), ["id", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            found = [sorted((at[w], n) for w, n in Counter(WORD.findall(cell.as_py().lower())).items() if w in at) for cell in batch.column(3)]
            arrays = [pa.array([[x[i] for x in row] for row in found], pa.list_(pa.int64())) for i in (0, 1)]
            digests = pa.array([text_digest(cell.as_py()) for cell in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], digests, *arrays], names=["id", "hash", "toxic", "digest", "terms", "counts"])

    schema = T.StructType([texts.schema["id"], T.StructField("hash", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("digest", T.BinaryType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("terms", "counts"))])
    rows = own.select("id", "hash", "toxic", "text").mapInArrow(run, schema).dropDuplicates(["hash"]).toArrow().sort_by("hash").combine_chunks()  # max_examples
    terms, counts = rows["terms"].combine_chunks(), rows["counts"].combine_chunks()
    sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
    x = _unit(np.repeat(np.arange(len(sizes)), sizes), terms.flatten().to_numpy(), counts.flatten().to_numpy(), len(sizes), weight)
    return at, build_index(x, rows["toxic"].to_pylist(), rows["id"].to_pylist(), weight, rate, k, rows["digest"].to_pylist())


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", k: int = 15, max_labelled: int = 12_000, max_examples: int = 1024, evidence: int = 3) -> DataFrame:
    """id, held_out, score, predicted and evidence (id, similarity and label of the nearest examples) of every row of df.

    Only labels of rows that aren't held out are learnt from; scores depend on texts alone. An example with a row's very text has no vote on it, as in the votes that the curve was fitted on. Null and empty texts, and texts
    without any term of the vocabulary, get the score of no neighbours, which is low where toxic texts are few. Without labels of both kinds that
    score is 0.1 for all. Repeated rows, and texts that share an id, are scored each by its own text; ties among neighbours go to the example that comes
    first in the index. Null ids are not held out, very long texts are read whole, further columns are not read, and an empty table gives an
    empty result.
    """
    at, index = _learnt(df, labels, id_col, text_col, label_col, k, max_labelled, max_examples)
    shared = df.sparkSession.sparkContext.broadcast((at, index))
    id_kind = df.schema[id_col].dataType
    proof = T.ArrayType(T.StructType([T.StructField("id", id_kind), T.StructField("similarity", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))
    schema = T.StructType([T.StructField(id_col, id_kind), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", proof)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = shared.value
        for batch in in_byte_slices(in_slices(batches, SLICE), 1):
            texts = batch.column(1).to_pylist()
            best, who = index.neighbours(rows_of_texts(texts, at, index.weight), k, index.own(texts))
            score = index.score(index.votes(best, who))
            why = [[{"id": index.ids[j], "similarity": float(s), "toxic": int(index.toxic[j])} for s, j in zip(b, w, strict=True) if s > 0] for b, w in zip(best[:, :evidence].tolist(), who[:, :evidence].tolist(), strict=True)]
            kind = pa.list_(pa.struct([("id", batch.schema.field(0).type), ("similarity", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(why, kind)], names=schema.names)

    out = _texts(df, id_col, text_col).mapInArrow(run, schema)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted", "evidence")


def without_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", k: int = 15, max_labelled: int = 12_000, max_examples: int = 1024) -> DataFrame:
    """The rows of df, with all columns, that :func:`score_toxicity` would not predict to be toxic; texts are read where they are, nothing is shuffled.

    Null texts count as empty and are scored as such; copies of a text are all kept or all gone; texts are scored whole, and an empty table
    gives an empty result.
    """
    at, index = _learnt(df, labels, id_col, text_col, label_col, k, max_labelled, max_examples)
    shared = df.sparkSession.sparkContext.broadcast((at, index))
    column = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = shared.value
        for batch in in_byte_slices(in_slices(batches, SLICE), column):
            texts = [text or "" for text in batch.column(column).to_pylist()]
            score = index.score(index.votes(*index.neighbours(rows_of_texts(texts, at, index.weight), k, index.own(texts))))
            yield batch.filter(pa.array(score < 0.5))

    return df.mapInArrow(run, df.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document, learnt from labels."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, labels)
