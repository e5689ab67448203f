"""Runs of words against direct searches."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from tidegauge.llm import periodic

WORD = re.compile("[^\x20\x09-\x0d]+")


def longest_lyndon(s):
    """The next place whose suffix is smaller, the end counting as smallest."""
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i)
    return out


@pytest.mark.parametrize("symbols", [1, 2, 3, 6])
def test_lyndon_lengths(symbols):
    rng = random.Random(symbols)
    for _ in range(400):
        s = [rng.randrange(symbols) for _ in range(rng.randrange(32))]
        assert periodic.lyndon_lengths(s) == longest_lyndon(s)


def direct_runs(w, least=24, times=3):
    """(start, length, period) by trying every period."""
    out, n = set(), len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            size = i + q - a
            if size >= max(least, times * q) and all(any(w[a + x] != w[a + x + r] for x in range(size - r)) for r in range(1, q) if q % r == 0):
                out.add((a, size, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def direct_collapse(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize(("least", "times"), [(24, 3), (1, 2), (6, 3), (2, 4)])
def test_runs_of_many_texts_at_once(least, times):
    rng = random.Random(least)
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(6)):
            k, w = rng.randrange(1, 6), []
            for _ in range(rng.randrange(5)):
                w += ([f"é{rng.randrange(k)}" for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 9))[: rng.randrange(40)]
            texts.append(rng.choice([" ", "\n", " \t "]).join(w) if w else rng.choice([None, "", " \n"]))
        got, left = periodic._of_texts(pa.array(texts, pa.string()), least, times)
        for text, runs, rest in zip(texts, got, left.to_pylist(), strict=True):
            w = WORD.findall(text or "")
            assert [(r["start"], r["length"], r["period"]) for r in runs] == direct_runs(w, least, times)
            assert rest == direct_collapse(w, direct_runs(w, least, times))


def test_bounds_of_runs():
    of = lambda w: [tuple(r.values()) for r in periodic._of_texts(pa.array([" ".join(w)]), 24, 3)[0][0]]
    eight = list("abcdefgh")
    assert of(eight * 3) == [(0, 24, 8)] and of((eight * 3)[1:]) == [] and of(["x", *eight * 3, "a", "y"]) == [(1, 25, 8)]
    assert of(["a"] * 23) == [] and of(["a"] * 24) == [(0, 24, 1)]
    nine = list("abcdefghi")
    assert of(nine * 2 + nine[:8]) == [] and of(nine * 3) == [(0, 27, 9)]
    assert of(["a", "b"] * 12 + ["a"] * 24) == [(0, 25, 2), (24, 24, 1)]


def planted(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_query_on_the_given_tables(spark, sf):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = planted(r.doc_id, r.text)
        runs = direct_runs(w)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[r.doc_id] = (len(runs), *top, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(direct_collapse(w, runs)))
    got = {r.doc_id: tuple(r[1:]) for r in periodic.query(spark, sf).collect()}
    assert got == want and sum(v[0] > 0 for v in want.values()) > 20


def test_edges(spark):
    long = " ".join(f"w{i % 5000}" for i in range(150_000))
    texts = [None, "", " \n\t", "one", "a " * 100_000, long, long, "x" * 500_000]
    df = spark.createDataFrame([(i if i else None, t, 1, [1]) for i, t in enumerate(texts)], "doc_id long, text string, start int, runs array<int>")
    got = {r.doc_id: r for r in periodic.periodic_runs(df).collect()}
    assert [len(got[i if i else None].runs) for i in range(8)] == [0, 0, 0, 0, 1, 1, 1, 0]
    assert tuple(got[4].strongest) == (0, 100_000, 1) and got[4].collapsed == "a" and tuple(got[5].strongest) == (0, 150_000, 5000)
    assert got[None].strongest is None and got[None].collapsed == "" and got[2].collapsed == "" and got[7].collapsed == "x" * 500_000
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        periodic.periodic_runs(df, times=1)
    tails = {r.doc_id: r for r in periodic.with_periodic_tails(df.withColumnRenamed("start", "_words"), "doc_id", "text").collect()}
    assert {k: v.text for k, v in tails.items()} == {i if i else None: t if t is None or not t.split() or zlib.crc32(str(i).encode()) % 10 or not i else " ".join(planted(i, t)) for i, t in enumerate(texts)}
    assert tails[4]["_words"] == 1
