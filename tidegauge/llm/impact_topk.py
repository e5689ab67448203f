"""Exact top-k inner products over an impact-ordered index, score at a time.

Components are quantised to integers; a component's impact level is the bit length of its size. The index holds, for
each shard of vectors, one segment of postings (vector, dimension, impact) for each level, and what length of each
vector is left below it. Segments are processed from the highest level down. After each, a vector's score lies within its accumulator
plus or minus the product of the query's length and what is left of the vector (Cauchy-Schwarz); when no vector but those already possible members can
reach the k-th best lower bound, the search ends, and the possible members are scored exactly, in integers. Queries meet shards in
blocks, each one packed row: a task holds one shard and one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.shared import written

SHARD, BLOCK = 2048, 2048
#: Queries whose accumulators are held at once in a task.
AT_ONCE = 128
INDEX = "shard long, level int, vec binary, dim binary, impact binary, left binary, rows binary, ids binary, width int"
FOUND = "query_row long, query_id long, vec_id long, score long"


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v): components x as floor(256 * x); vectors that are null or hold null or non-finite components are left out."""
    x = F.col(f"`{vector_col}`")
    good = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x"), good.alias("good")).filter(F.col("good") & F.col("id").isNotNull())
    whole = lambda e: F.floor(e.cast("double") * 256)
    fits = F.forall("x", lambda e: F.abs(e.cast("double")) < F.lit(2.0**55))
    checked = F.when(fits, F.transform("x", lambda e: whole(e).cast("long"))).otherwise(F.raise_error(F.lit("a component's integer doesn't fit in 64 bits")).cast("array<bigint>"))
    return rows.select("row", "id", checked.alias("v"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    x = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    return x


def build(pdf: pd.DataFrame) -> pd.DataFrame:
    """The segments of one shard."""
    pdf = pdf.sort_values(["id", "row"])
    width = max(1, pdf["v"].map(len).max())
    x = _matrix(pdf["v"], width)
    size = np.abs(x.astype(np.float64))
    level = np.ceil(np.log2(size + 1.0)).astype(int)
    out = []
    for k in sorted(set(level.ravel().tolist()) - {0}, reverse=True) or [0]:
        vec, dim = np.nonzero(level == k)
        left = np.sqrt(np.where(level < k, size**2, 0).sum(1))
        out.append((pdf["shard"].iloc[0], k, vec.astype("<i4").tobytes(), dim.astype("<i4").tobytes(), x[vec, dim].astype("<i8").tobytes(), left.astype("<f8").tobytes(), pdf["row"].to_numpy("<i8").tobytes(), pdf["id"].to_numpy("<i8").tobytes(), width))
    return pd.DataFrame(out, columns=["shard", "level", "vec", "dim", "impact", "left", "rows", "ids", "width"])


def packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The queries of one block as one row."""
    x = _matrix(pdf["v"], max(1, pdf["v"].map(len).max()))
    return pd.DataFrame([(pdf["block"].iloc[0], pdf["row"].to_numpy("<i8").tobytes(), pdf["id"].to_numpy("<i8").tobytes(), x.astype("<i8").tobytes())], columns=["block", "rows", "ids", "v"])


def _exact(x: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The inner products of rows of x with q, exact; size: bounds of theirs. An error if one doesn't fit in 64 bits."""
    if size.max(initial=0) < 2.0**62:
        return x @ q
    every = [sum(a * b for a, b in zip(v, q.tolist(), strict=True)) for v in x.tolist()]
    if any(abs(s) >= 2**63 for s in every):
        raise OverflowError("a score doesn't fit in 64 bits")
    return np.array(every, np.int64)


def search(index: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one shard for each query of a block, without the query's own row. A query stops by itself, when it is proven who its possible members are."""
    index = index.sort_values("level", ascending=False)
    rows, ids = (np.frombuffer(index[c].iloc[0], "<i8") for c in ("rows", "ids"))
    q_rows, q_ids = (np.frombuffer(queries[c].iloc[0], "<i8") for c in ("rows", "ids"))
    asked = np.frombuffer(queries["v"].iloc[0], "<i8").reshape(len(q_rows), -1)
    n, width = len(ids), int(index["width"].iloc[0])
    common = min(width, asked.shape[1])  # components beyond are zero on one side
    whole = np.zeros((n, width), np.int64)
    segments = []
    for s in index.itertuples():
        vec, dim, impact = np.frombuffer(s.vec, "<i4"), np.frombuffer(s.dim, "<i4"), np.frombuffer(s.impact, "<i8")
        whole[vec, dim] = impact
        used = np.unique(dim[dim < common])
        part = np.zeros((len(used), n))
        own = np.isin(dim, used)
        part[np.searchsorted(used, dim[own]), vec[own]] = impact[own]
        segments.append((used, part, np.frombuffer(s.left, "<f8")))
    whole = whole[:, :common]
    norm = np.sqrt((whole.astype(np.float64) ** 2).sum(1))
    out: list[tuple] = []
    for at in range(0, len(asked), AT_ONCE):
        exact_q = asked[at : at + AT_ONCE, :common]
        q = exact_q.astype(np.float64)
        mine = rows[None, :] == q_rows[at : at + AT_ONCE, None]
        length = np.sqrt((q * q).sum(1, keepdims=True)) * (1 + 1e-9)
        rounding = length * norm * (common + 4) * 2.0**-50  # of sums and products in double precision
        acc = np.zeros((len(q), n))
        may = ~mine
        active = np.arange(len(q))
        for used, part, left in segments:
            acc[active] += q[np.ix_(active, used)] @ part
            slack = length[active] * left + rounding[active]
            low = np.where(mine[active], -np.inf, acc[active] - slack)
            least = np.partition(low, -k, axis=1)[:, -k, None] if n > k else np.full((len(active), 1), -np.inf)
            may[active] = (acc[active] + slack >= least) & ~mine[active]
            active = active[may[active].sum(1) > 2 * k]
            if not len(active):
                break
        for i in range(len(q)):
            these = np.flatnonzero(may[i])
            score = _exact(whole[these], exact_q[i], length[i] * norm[these])
            best = np.lexsort((ids[these], -score))[:k] if len(score) and score.min() > -(2**63) else sorted(range(len(these)), key=lambda j: (-int(score[j]), int(ids[these[j]])))[:k]  # noqa: B023
            out += [(q_rows[at + i], q_ids[at + i], ids[these[j]], score[j]) for j in best]
    return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"])


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for each row whose id is divisible by ``every``, against all other rows.

    Scores are exact; one that doesn't fit in 64 bits is an error, as is a component whose integer doesn't. Ties go to the smaller id. Fewer than k
    others give fewer rows. Shorter vectors count as filled up with zeros, and long ones are searched whole. Repeated rows are
    candidates each, and queries each (their ranks then come once for each). Null ids, and vectors that are null
    or hold null or non-finite components, take no part; an empty table gives an empty result. Further columns are not read.
    """
    rows = written(quantised(df, id_col, vector_col), "quantised")
    n = rows.count()
    shards = max(1, -(-n // SHARD))
    index = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).groupBy("shard").applyInPandas(build, INDEX)
    index = written(index, "index")
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0)
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(blocks)))
    asked = written(asked.groupBy("block").applyInPandas(packed, "block long, rows binary, ids binary, v binary"), "queries")
    all_shards, all_blocks = (F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x - 1).cast("long"))) for x in (shards, blocks))
    pairs = asked.withColumn("shard", all_shards).groupBy("shard", "block"), index.withColumn("block", all_blocks).groupBy("shard", "block")

    def one(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return search(own, queries, k) if len(own) and len(queries) else pd.DataFrame(columns=["query_row", "query_id", "vec_id", "score"])

    found = pairs[0].cogroup(pairs[1]).applyInPandas(one, FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """The five best for each query row of embeddings."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
           FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
