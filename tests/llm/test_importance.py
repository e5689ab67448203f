"""Importance resampling against a direct computation."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidegauge.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def direct(docs, goal):
    """{doc_id: (n_features, weight, score, rank)} for unique ids."""
    own = {i: runs(t) for i, t in docs}
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = collections.Counter(bucket(f) for _, x in own.values() for f in x), collections.Counter(bucket(f) for x in goal for f in runs(x)[1])
    total_s, total_t = s.total(), t.total()
    out = {}
    for i, (_, found) in own.items():
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out[i] = (len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    able = sorted((-out[i][2], i) for i, (n, _) in own.items() if n >= 20)
    rank = {i: r for r, (_, i) in enumerate(able[: 5 * len(able) // 100], 1)}
    return {i: (*v, rank.get(i)) for i, v in out.items()}


def told(df):
    return {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()}


def test_query_on_the_given_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    goal = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert told(importance.query(spark, sf)) == direct(docs, goal)


ODD = ["a", "B", "Ab", "é", "É", "日本", "x1", "0", "-", "@", "[", "`", "{", "~", "\x7f", " ", " ", "\n", "\0", "😀", "zz" * 40]


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(importance, "SEGMENT", 37)
    rng = random.Random(3)
    docs = [(i, "".join(rng.choices(ODD, k=rng.randrange(200)))) for i in range(150)] + [(900, None), (901, ""), (902, "w" * 300_000), (903, "a b " * 40_000)]
    goal = [("".join(rng.choices(ODD, k=60)),) for _ in range(5)] + [(None,)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, packed string").repartition(3)
    assert told(importance.resample(df, spark.createDataFrame(goal, "text string"))) == direct(docs, [g for g, in goal])


def test_words_in_parts_are_the_same(monkeypatch):
    rng = random.Random(1)
    import pyarrow as pa

    texts = pa.array(["".join(rng.choices(ODD, k=rng.randrange(300))) for _ in range(40)])[5:30]
    words = importance.words_of(texts, importance.IS_WORD, importance.LOWER)
    key = lambda: sorted((int(t), int(b)) for text, bucket in importance.features(words, 10_000, 3) for t, b in zip(text, bucket))
    whole = key()
    monkeypatch.setattr(importance, "SEGMENT", 7)
    assert key() == whole and len(whole) == sum(len(runs(t)[1]) for t in texts.to_pylist())


@pytest.mark.parametrize("cells", [1, 50, 10**6])
def test_checksums(monkeypatch, cells):
    monkeypatch.setattr(importance, "CELLS", cells)
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    sizes = rng.integers(0, 30, 800)
    starts = rng.integers(0, 2900, 800)
    assert importance.crcs(data, starts, sizes).tolist() == [zlib.crc32(data[a : a + n]) for a, n in zip(starts.tolist(), sizes.tolist())]


def test_empty_tables_repeated_rows_and_ties(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(7, text)] * 30 + [(None, text)] * 30, "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    rows = importance.resample(df, none, percent=50).collect()
    assert len(rows) == 60 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 31)) and all(r.n_words == 25 for r in rows)
    assert len({(r.doc_id, r.score) for r in rows}) == 2
    strings = spark.createDataFrame([("b", text), ("a", "")], "name string, body string")
    assert [(r["name"], r["rank"]) for r in importance.resample(strings, none, "name", "body", percent=100).orderBy("name").collect()] == [("a", None), ("b", 1)]
