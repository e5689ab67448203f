"""Scores of documents by a lexicon of words in categories."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import ratio
from tidegauge.operators.ranges import broadcast_if_small
from tidegauge.sources.sinks import written


def tokens(c):
    """Runs of a-z of the lower-cased text; an empty list for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]+)"), F.lit(1))


def compact(master: DataFrame, categories: list[str]) -> DataFrame:
    """(word, category) from a table with a column a category, non-zero meaning membership; words in lower case, repeated ones by their first row."""
    first = master.withColumn("word", F.lower("word")).groupBy("word").agg(F.min_by(F.struct(*categories), "line").alias("m")).select("word", "m.*")
    return first.unpivot("word", categories, "category", "member").filter("member <> 0").select("word", "category")


def category_counts(docs: DataFrame, lexicon: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and a count a category for every document, those without tokens too, and once for each of rows that share an id.

    The lexicon is counted, and broadcast if it is small; else words are shuffled to it. Words are exploded, looked up and summed where their document is read, so what is
    shuffled is one row of counts for each document; rows are numbered within this one scan.
    """
    bit = F.coalesce(*[F.when(F.col("category") == c, F.lit(1 << i)) for i, c in enumerate(categories)], F.lit(0))
    member = lexicon.groupBy(F.col("word").alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    rows = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text"))
    words = rows.select("_id", "_row", F.explode_outer(tokens(F.col("_text"))).alias("_word"))
    found = words.join(broadcast_if_small(written(member, "lexicon")), "_word", "left")
    counts = [F.count(F.when(F.col("_bits").bitwiseAND(F.lit(1 << i)) > 0, 1)).alias(c) for i, c in enumerate(categories)]
    # the id is a key, as a hashed aggregation holds numbers only: else all words are sorted, each with its document's id
    return found.groupBy("_row", F.col("_id").alias(id_col)).agg(F.count("_word").alias("n_tokens"), *counts).drop("_row")


def scores_of_sources(sources: dict[str, DataFrame], lexicon: DataFrame, categories: list[str], id_col: str, text_col: str, at_col: str) -> DataFrame:
    """source, id, at and the scores of every document of all sources; a source that lacks one of the columns is left out with a warning. All sources are counted in one scan.

    Documents without a text have counts of 0 and no tone. Without a source left the error says so.
    """
    own = {name: df for name, df in sources.items() if {id_col, text_col, at_col} <= set(df.columns)}
    if left := sorted(set(sources) - set(own)):
        warnings.warn(f"sources {left} lack columns of {[id_col, text_col, at_col]}", stacklevel=2)
    if not own:
        raise ValueError("no source has the columns")
    parts = [df.select(F.struct(F.lit(name).alias("source"), F.col(id_col).alias("id"), F.col(at_col).alias("at")).alias("_at"), F.col(text_col).alias("_body")) for name, df in own.items()]
    found = scores(category_counts(reduce(DataFrame.unionByName, parts), lexicon, categories, "_at", "_body"), categories)
    return found.select(F.col("_at.source").alias("source"), F.col("_at.id").alias(id_col), F.col("_at.at").alias(at_col), *[c for c in found.columns if c != "_at"])


def scores(counts: DataFrame, categories: list[str], positive: str = "positive", negative: str = "negative") -> DataFrame:
    """counts with per_1000 and share of each category (0 without tokens), and tone: positive less negative over both, null without either."""
    share = {c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n_tokens").cast("double")), F.lit(0.0)) for c in categories}
    tone = ratio((F.col(positive) - F.col(negative)).cast("double"), (F.col(positive) + F.col(negative)).cast("double"))
    return counts.select("*", *[(s * 1000).alias(f"{c}_per_1000") for c, s in share.items()], *[s.alias(f"{c}_ratio") for c, s in share.items()], tone.alias("tone"))
