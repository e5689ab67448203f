"""Nearest rows against brute force, and rows made between them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import neighbours


def brute(rows, k):
    out = {}
    for g in {r[0] for r in rows}:
        own = [(key, np.array(x)) for h, key, x in rows if h == g]
        for key, x in own:
            out[key] = sorted((float(np.sqrt(((x - y) ** 2).sum())), other) for other, y in own if other != key)[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(g, key, [float(v) for v in x]) for g, key, x in rows], "g string, k long, x array<double>").repartition(3)


def test_all_cells_give_exact_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MEMBERS", 7)
    monkeypatch.setattr(neighbours, "ASKERS", 11)
    rng = np.random.default_rng(1)
    rows = [("ab"[i % 2], i, rng.normal(0, 1, 3)) for i in range(120)] + [("b", 500 + i, [0.0, 0.0, 0.0]) for i in range(9)] + [("one", 900, [1.0, 2.0, 3.0]), ("two", 901, [0.0] * 3), ("two", 902, [1.0] * 3)]
    got = neighbours.near_rows(frame(spark, rows), "g", "k", "x", 3, 4, first=0.3, second=1.0).collect()
    want = brute(rows, 4)
    assert len(got) == len(rows) and all(r.proven for r in got)
    for r in got:
        assert [n.k for n in r.near] == [k for _, k in want[r.k]] and np.allclose([n.distance for n in r.near], [d for d, _ in want[r.k]])


def test_recall_and_proofs(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/embeddings.parquet").filter("embedding is not null")
    rows = [((r.label or 0) % 3, r.vec_id, r.embedding) for r in df.collect()]
    source = df.select((F.col("label") % 3).alias("g"), F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("x"))
    got = neighbours.near_rows(source, "g", "k", "x", len(rows[0][2]), 5).collect()
    want = brute(rows, 5)
    hits = [len({n.k for n in r.near} & {k for _, k in want[r.k]}) / max(1, len(want[r.k])) for r in got]
    assert len(got) == len(rows) and sum(hits) / len(hits) >= 0.9
    assert all(h == 1 for h, r in zip(hits, got, strict=True) if r.proven)


@pytest.mark.parametrize("k", [2, 5])
def test_made_rows_lie_between_rows_of_their_class(spark, k):
    rng = np.random.default_rng(2)
    rows = [(0, i, *rng.normal(0, 1, 2).tolist()) for i in range(50)] + [(1, 100 + i, *rng.normal(9, 1, 2).tolist()) for i in range(12)] + [(2, 200, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "label int, key long, a double, b double")
    out = neighbours.oversampled(df, ["a", "b"], "label", "key", k).collect()
    made = [r for r in out if r.is_made]
    assert len(out) - len(made) == 63 and {r.label for r in made} == {1} and len(made) == 12 * 4
    points = np.array([r[2:] for r in rows if r[0] == 1])
    for r in made:
        x, best = np.array([r.a, r.b]), 1.0
        for p in points:
            for q in points:
                best = min(best, np.linalg.norm(x - p) + np.linalg.norm(q - x) - np.linalg.norm(q - p))
        assert best < 1e-9
    assert sorted(map(tuple, out)) == sorted(map(tuple, neighbours.oversampled(df.repartition(5), ["a", "b"], "label", "key", k).collect()))
    assert neighbours.near_rows(df.limit(0).select("label", "key", F.array("a", "b").alias("x")), "label", "key", "x", 2, 3).count() == 0
