"""Language labels: the chain against enumeration, held-out accuracy, and code-switched text."""

import itertools
import zlib

import numpy as np
import pytest

from tidegauge.llm import language


@pytest.mark.parametrize("labels", [1, 2, 3])
def test_forward_backward_is_enumeration(labels):
    rng = np.random.default_rng(labels)
    sizes = np.array([3, 1, 4, 2])
    starts = np.cumsum(sizes) - sizes
    scores, start, move = rng.normal(0, 2, (10, labels)), rng.normal(0, 1, labels), rng.normal(0, 1, (labels, labels))
    got, pairs = language.forward_backward(scores, language.Chains.of(starts, sizes), start, move, pairs=True)
    want, expected = np.zeros_like(scores), np.zeros_like(move)
    for a, n in zip(starts, sizes):
        ways = list(itertools.product(range(labels), repeat=int(n)))
        weight = np.array([np.exp(start[w[0]] + sum(scores[a + t, y] for t, y in enumerate(w)) + sum(move[x, y] for x, y in zip(w, w[1:]))) for w in ways])
        for w, p in zip(ways, weight / weight.sum()):
            for t, y in enumerate(w):
                want[a + t, y] += p
            for x, y in zip(w, w[1:]):
                expected[x, y] += p
    assert np.allclose(got, want) and np.allclose(pairs, expected)


def test_long_chains_stay_finite():
    scores = np.random.default_rng(1).normal(0, 50, (20_000, 3))
    p, _ = language.forward_backward(scores, language.Chains.of(np.array([0]), np.array([20_000])), np.zeros(3), np.array([[3.0, -9, -9], [-9, 3, -9], [-9, -9, 3]]))
    assert np.isfinite(p).all() and np.allclose(p.sum(axis=1), 1)


def test_pieces_are_those_of_each_word():
    words = ["a", "ab", "straße", "日本語", "a", "x" * 3000]
    found, starts = language.pieces_of(words)
    ends = [*starts[1:], len(found)]
    whole = [found[a:b].tolist() for a, b in zip(starts, ends)]
    assert whole == [language.pieces_of([w])[0].tolist() for w in words]
    assert [len(x) for x in whole] == [sum(max(0, len(w) + 2 - k) for k in range(4)) for w in words] and found.max() < 1 << language.BITS


def test_held_out_accuracy(spark, sf):
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = language.query(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(want) and len(rows) == len(want)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    own = [r.lang_pred == want[r.doc_id] for r in rows if r.held_out]
    assert len(own) > 20 and sum(own) / len(own) >= 0.97


EN, DE = "the cat sat on the mat and the dog was there with them", "der hund und die katze sind nicht auf dem tisch oder dort"


def trained(spark):
    rows = [(i, " ".join(np.random.default_rng(i).permutation((EN if i % 2 else DE).split()).tolist()) + ".", "en" if i % 2 else "de") for i in range(60)]
    return rows, "doc_id long, text string, lang string"


def test_code_switched_words(spark):
    rows, schema = trained(spark)
    text = "The cat was there with the dog and der hund und die katze sind nicht dort."
    out = language.identify(spark.createDataFrame([*rows, (1000, text, None), (1001, f"{EN}. {DE}. {EN}", None)], schema), with_spans=True).filter("doc_id >= 1000").orderBy("doc_id").collect()
    assert [tuple(s) for s in out[0].spans] == [("en", 0, 8), ("de", 8, 8)]
    assert [s.label for s in out[1].spans] == ["en", "de", "en"] and [s.first for s in out[1].spans] == [0, 13, 25] and out[1].lang_pred == "en"


def test_labels_ids_and_sources_of_rows_are_no_input(spark):
    rows, schema = trained(spark)
    held = [i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 5 == 0][:4]
    key = lambda own: sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(own, schema)).collect() if r.doc_id in held)
    told = key([*rows, *[(i, EN, "de") for i in held]])
    assert told == key([*rows, *[(i, EN, None) for i in held]]) and {x[1] for x in told} == {"en"} and len({x[2] for x in told}) == 1


def test_edges(spark):
    rows, schema = trained(spark)
    odd = [(2001, None, "en"), (2002, "", "xx"), (2003, "12 34 -- ²½", None), (None, EN, "en"), (None, EN, "en"), (2004, "the " * 60_000, None), (2005, "x" * 300_000, None), (2006, "日本語", None), (2007, "١٢٣ _", None)]
    df = spark.createDataFrame([(*r, 0.5, "h") for r in [*rows, *odd]], schema + ", score double, held_out string").repartition(4)
    out = language.identify(df, with_spans=True).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 69 and [got[i].lang_pred for i in (2001, 2002, 2003, 2007)] == ["und"] * 4 and all(got[i].score == 0 and got[i].lang_pred == "und" for i in (2001, 2002, 2003, 2007))
    assert got[2004].lang_pred == "en" and not got[None].held_out and got[2006].lang_pred in ("en", "de") and got[2005].lang_pred in ("en", "de")
    assert language.identify(df.limit(0)).count() == 0
    nothing = language.identify(df.withColumn("lang", language.F.lit(None).cast("string")), with_spans=True).collect()
    assert len(nothing) == 69 and {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    one = language.identify(df.filter("lang = 'en' or doc_id is null or doc_id > 2000").filter("text is not null")).collect()
    assert {r.lang_pred for r in one if r.doc_id == 2006} <= {"en", "xx"}
