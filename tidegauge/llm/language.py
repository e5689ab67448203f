"""Language of texts by a linear-chain conditional random field over their words.

A word's score for a language comes from its affixes and n-grams (hashed pieces of one to four characters of the word between boundary marks) and from a lexicon: how often the word stood in
training texts of each language. Scores of neighbouring words are tied by learned transitions, and the forward-backward algorithm gives the
probability of each language at each word of a sentence. It is trained on sentences that are put together from pieces of different languages, so it labels words of code-switched
text. A text's language is the one with the largest mean probability over its words.

The model is fitted on the driver, on at most ``max_documents`` distinct texts of each language, of which at most ``PIECES`` pieces of ``PIECE`` words are taken; texts
are labelled where they are read, sentences of a whole slice of texts at once, and nothing but hashes of labelled texts is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.shared import in_byte_slices, in_slices, written

#: Words, and what ends a sentence.
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
ENDS = ".!?\n"
BITS = 16
LONGEST = 4
#: Pieces of a training text, words of a piece, and letters of the words that are learnt from.
PIECES, PIECE, LETTERS = 6, 24, 40
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.3, 1e-5
UNKNOWN = "und"


def pieces_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed pieces of 1 to LONGEST characters of all words, each between two boundary marks, and where those of each word start."""
    text = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32)
    word = np.repeat(np.arange(len(words)), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    found, own = [], []
    h = np.zeros(len(text), np.uint32)
    for size in range(1, LONGEST + 1):
        h = h[: len(text) - size + 1] * np.uint32(1_000_003) + text[size - 1 :]
        same = word[: len(h)] == word[size - 1 :]
        found.append(((h[same] ^ np.uint32(size)) * np.uint32(2_654_435_769)) >> np.uint32(32 - BITS))
        own.append(word[: len(h)][same])
    row = np.concatenate(own)
    order = np.argsort(row, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.searchsorted(row[order], np.arange(len(words)))


@dataclass
class Chains:
    """Sequences within an array of words, the longest first: where each starts, and how many are longer than each number of words."""

    starts: np.ndarray
    active: np.ndarray

    @classmethod
    def of(cls, starts: np.ndarray, sizes: np.ndarray) -> Chains:
        order = np.argsort(-sizes, kind="stable")
        top = int(sizes.max()) if len(sizes) else 0
        return cls(starts[order], len(sizes) - np.cumsum(np.bincount(sizes, minlength=top + 1))[:top])


def forward_backward(scores: np.ndarray, chains: Chains, start: np.ndarray, move: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The probability of each label at each word, and the expected number of each pair of neighbouring labels, if asked for.

    scores: of labels by word; start and move: scores of first labels and of transitions. All sequences go forward together, each step scaled to a sum of one.
    """
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    m = np.exp(move - move.max())
    alpha, beta = np.empty_like(local), np.ones_like(local)
    for t, n in enumerate(chains.active.tolist()):
        at = chains.starts[:n] + t
        a = local[at] * (alpha[at - 1] @ m if t else np.exp(start - start.max()))
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros_like(m) if pairs else None
    for t in range(len(chains.active) - 2, -1, -1):
        at = chains.starts[: chains.active[t + 1]] + t
        after = local[at + 1] * beta[at + 1]
        if pairs:
            both = alpha[at][:, :, None] * m * after[:, None, :]
            expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = after @ m.T
        beta[at] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True), expected


@dataclass
class Crf:
    """Labels, the lexicon's words with their log-odds by label, and weights: of hashed pieces, of the lexicon's log-odds (and of not being in it), of first labels and transitions."""

    labels: list[str]
    lexicon: dict[str, int]
    odds: np.ndarray
    pieces: np.ndarray
    known: np.ndarray
    start: np.ndarray
    move: np.ndarray

    def lexical(self, words: list[str]) -> np.ndarray:
        """Log-odds of each word by label, and a last column of ones for words that the lexicon hasn't."""
        at = np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))
        out = np.zeros((len(words), len(self.labels) + 1), np.float32)
        out[at >= 0, :-1] = self.odds[at[at >= 0]]
        out[at < 0, -1] = 1
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """Of each label for each word by itself."""
        found, starts = pieces_of(words)
        scale = 1 / np.sqrt(np.diff(np.append(starts, len(found))))
        return np.add.reduceat(self.pieces[found], starts, axis=0) * scale[:, None].astype(np.float32) + self.lexical(words) @ self.known


def lexicon_of(sequences: list[tuple[list[str], int]], labels: int) -> tuple[dict[str, int], np.ndarray]:
    """The words that occur twice or more, and their smoothed log-odds by label."""
    total, by = Counter(), Counter()
    for words, label in sequences:
        total.update(words)
        by.update((w, label) for w in words)
    at = {w: i for i, w in enumerate(w for w, n in total.items() if n > 1)}
    counts = np.full((len(at), labels), 0.5, np.float32)
    for (w, label), n in by.items():
        if w in at:
            counts[at[w], label] += n
    return at, np.log(counts / counts.sum(axis=1, keepdims=True) * labels).astype(np.float32)


def mixed(sequences: list[tuple[list[str], int]], rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Training sequences: half of them as they are, the others cut and put together with one or two of other places."""
    out = []
    for k in rng.permutation(len(sequences)).tolist():
        words, y = [], []
        for i in [k, *rng.integers(0, len(sequences), int(rng.integers(1, 3))).tolist()] if rng.random() < 0.5 else [k]:
            own, label = sequences[i]
            a = int(rng.integers(0, max(1, len(own) - 3))) if i != k else 0
            part = own[a : a + int(rng.integers(2, 13))] if len(words) or i != k else own
            words += part
            y += [label] * len(part)
        out.append((words, y))
    return out


def fit(sequences: list[tuple[list[str], int]], labels: list[str]) -> Crf:
    """A model from (words, label's number); every other sequence makes the lexicon, and the rest the weights. The same input gives the same model."""
    n = len(labels)
    lexicon, odds = lexicon_of(sequences[::2], n)
    zero = lambda *shape: np.zeros(shape, np.float32)
    crf = Crf(labels, lexicon, odds, zero(1 << BITS, n), zero(n + 1, n), zero(n), zero(n, n))
    own, rng = sequences[1::2] or sequences, np.random.default_rng(13)
    squares = [np.full_like(w, 1e-2) for w in (crf.pieces, crf.known, crf.start, crf.move)]
    for _ in range(EPOCHS if n > 1 and own else 0):
        todo = mixed(own, rng)
        for part in (todo[at : at + BATCH] for at in range(0, len(todo), BATCH)):
            at: dict[str, int] = {}
            token = np.array([at.setdefault(w, len(at)) for words, _ in part for w in words])
            y = np.array([v for _, own_y in part for v in own_y])
            sizes = np.array([len(words) for words, _ in part])
            starts = np.cumsum(sizes) - sizes
            words = list(at)
            found, first = pieces_of(words)
            count = np.diff(np.append(first, len(found)))
            lexical = crf.lexical(words)
            scale = 1 / np.sqrt(count)
            local = np.add.reduceat(crf.pieces[found], first, axis=0) * scale[:, None] + lexical @ crf.known
            p, pair = forward_backward(local[token].astype(np.float64), Chains.of(starts, sizes), crf.start, crf.move, pairs=True)
            p[np.arange(len(y)), y] -= 1  # the gradient by word
            follows = np.ones(len(y), bool)
            follows[starts] = False
            later = np.flatnonzero(follows)
            np.subtract.at(pair, (y[later - 1], y[later]), 1)
            g = np.stack([np.bincount(token, p[:, k], len(words)) for k in range(n)], axis=1)
            spread = np.repeat(g * scale[:, None], count, axis=0)
            steps = (np.stack([np.bincount(found, spread[:, k], 1 << BITS) for k in range(n)], axis=1), lexical.T @ g, p[starts].sum(axis=0), pair)
            for w, s, d in zip((crf.pieces, crf.known, crf.start, crf.move), squares, steps, strict=True):
                d = (d / len(part) + DECAY * w).astype(np.float32)
                s += d * d
                w -= RATE * d / np.sqrt(s)
    return crf


def held_out(id_col: str):
    """Whether the checksum of the id as text is a multiple of five; never for null ids."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_pieces(df: DataFrame, id_col: str, text_col: str, label_col: str, max_documents: int) -> tuple[list[tuple[list[str], int]], list[str]]:
    """(words, label's number) of pieces of at most so many distinct texts of each label, and the labels in order. Rows that are held out or have no label are left out.

    Only ids and hashes are shuffled; texts are chosen by their hashes, and of rows that share a text one stands for it.
    """
    rows = df.filter(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    texts = written(rows.groupBy("hash", "label").agg(F.min("id").alias("id")), "labelled")
    labels = sorted(r["label"] for r in texts.select("label").distinct().collect())  # the classes of the model
    chosen = None
    for label in labels:
        own = texts.filter(F.col("label") == label).orderBy("hash").limit(max_documents)
        chosen = own if chosen is None else chosen.unionByName(own)
    if chosen is None:
        return [], []
    own = rows.join(F.broadcast(chosen), (rows["hash"] == chosen["hash"]) & (rows["label"] == chosen["label"]) & rows["id"].eqNullSafe(chosen["id"])).select(rows["hash"], rows["label"], rows["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            words = [w for w in TOKEN.findall(batch.column(2)[0].as_py().lower()) if w not in ENDS and len(w) <= LETTERS]
            step = max(PIECE, len(words) // PIECES)
            parts = [" ".join(words[at : at + PIECE]) for at in range(0, len(words), step)][:PIECES]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[0].as_py()] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([batch.column(1)[0].as_py()] * len(parts), pa.string()), pa.array(parts, pa.string())], names=["hash", "piece", "label", "words"])

    found = own.mapInArrow(run, "hash long, piece int, label string, words string").dropDuplicates(["hash", "label", "piece"]).toArrow()
    number = {x: i for i, x in enumerate(labels)}
    ordered = sorted(zip(*(found[c].to_pylist() for c in ("hash", "piece", "label", "words")), strict=True))
    # sequences alternate between lexicon and weights, so those of one text stay together
    texts_at = {h: i for i, h in enumerate(dict.fromkeys(x[0] for x in ordered))}
    halves = [[(w.split(" "), number[label]) for h, _, label, w in ordered if texts_at[h] % 2 == side] for side in (0, 1)]
    size = max(map(len, halves))
    filled = [[half[i % len(half)] for i in range(size)] if half else [] for half in halves]
    return [x for pair in zip(*filled, strict=True) for x in pair] if all(filled) else [*halves[0], *halves[1]], labels


class Numbered(dict):
    """Words by number, in the order in which they are first asked for; what ends a sentence has number 0."""

    def __init__(self):
        super().__init__(dict.fromkeys(ENDS, 0))
        self.new: list[str] = []
        self.count = 1

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = self.count
        self.count += 1
        return n


class Labeller:
    """Labels texts; the scores of words are remembered, up to a bounded number."""

    def __init__(self, crf: Crf, most: int = 200_000):
        self.crf, self.most = crf, most
        self._clear()

    def _clear(self) -> None:
        self.at = Numbered()
        self.scores = np.zeros((1, len(self.crf.labels)), np.float32)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, sentence's break before, probabilities) of every word of the texts."""
        if self.at.count > self.most:
            self._clear()
        parts = [list(map(self.at.__getitem__, TOKEN.findall((t or "").lower()))) for t in texts]
        if self.at.new:
            rows = [self.crf.scores(self.at.new[i : i + 20_000]) for i in range(0, len(self.at.new), 20_000)]
            self.scores = np.concatenate([self.scores, *rows])
            self.at.new = []
        token = np.fromiter((x for p in parts for x in p), np.int64)
        text = np.repeat(np.arange(len(texts)), list(map(len, parts)))
        is_word = token > 0
        sentence = np.cumsum(~is_word)[is_word]
        token, text = token[is_word], text[is_word]
        cut = np.ones(len(token), bool)
        cut[1:] = (np.diff(sentence) > 0) | (np.diff(text) > 0)
        starts = np.flatnonzero(cut)
        if not len(token) or not self.crf.labels:
            return text, cut, np.zeros((len(token), len(self.crf.labels)))
        p, _ = forward_backward(self.scores[token].astype(np.float64), Chains.of(starts, np.diff(np.append(starts, len(token)))), self.crf.start, self.crf.move)
        return text, cut, p


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_documents: int = 300, with_spans: bool = False) -> DataFrame:
    """id, held_out, lang_pred, score and, if asked for, spans of every row of df.

    The model learns from rows with a label that aren't held out; predictions depend on texts alone. lang_pred: the label with the largest mean
    probability over the text's words, ties to the first in sorted order; score: that mean. Null and empty texts, texts without a letter, and all texts if there is nothing to
    learn from are ``und`` with score 0. spans: (label, first word, words) of each stretch of words whose most probable label is the same.

    Repeated rows are labelled each by itself, null ids are not held out, very long texts are read whole, other columns are not read, and an empty table gives an empty result.
    """
    sequences, labels = training_pieces(df, id_col, text_col, label_col, max_documents)
    shared = df.sparkSession.sparkContext.broadcast(fit(sequences, labels))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("words", T.LongType())])
    schema = T.StructType([rows.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField("spans", T.ArrayType(span))] if with_spans else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        names = np.array([*shared.value.labels, UNKNOWN], object)
        for batch in in_byte_slices(in_slices(batches, 5000), 1):
            texts = batch.column(1).to_pylist()
            text, _, p = labeller.words(texts)
            mean = np.stack([np.bincount(text, p[:, k], len(texts)) for k in range(p.shape[1])], axis=1) if p.shape[1] else np.zeros((len(texts), 0))
            mean /= np.maximum(np.bincount(text, minlength=len(texts)), 1)[:, None]
            good = np.array([has_letter(t) for t in texts], bool) & (mean.sum(axis=1) > 0)
            best = np.where(good, mean.argmax(axis=1), -1) if mean.shape[1] else np.full(len(texts), -1)
            score = np.where(good, np.minimum(mean.max(axis=1), 1.0), 0.0) if mean.shape[1] else np.zeros(len(texts))
            columns = [batch.column(0), pa.array(names[best], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*columns, *([_spans(text, p, names, len(texts))] if with_spans else [])], names=schema.names)

    out = rows.mapInArrow(run, schema).withColumn("held_out", held_out("id"))
    return out.select(F.col("id").alias(id_col), "held_out", *schema.names[1:])


def _spans(text: np.ndarray, p: np.ndarray, names: np.ndarray, count: int) -> pa.Array:
    """The stretches of words of each text that have the same most probable label."""
    best = p.argmax(axis=1) if p.shape[1] and len(p) else np.zeros(len(text), np.int64)
    cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(text)), bool), (np.diff(text) > 0) | (np.diff(best) != 0)]))
    size = np.diff(np.append(cut, len(text)))
    first = cut - np.searchsorted(text, text[cut])
    rows = pa.StructArray.from_arrays([pa.array(names[best[cut]], pa.string()), pa.array(first), pa.array(size)], ["label", "first", "words"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(text[cut], minlength=count))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document, learnt from those that aren't held out."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
