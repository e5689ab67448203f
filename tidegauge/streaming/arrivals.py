"""Late and revised observations as a stream: what batch rebuilds do by publication date, kept up to date by each arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrivals(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of long observations as they come to a folder."""
    return spark.readStream.schema(schema).parquet(path)


def latest_by_series(stream: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the latest published observation so far: publication_date, observation_date and value; rows not published yet don't count.

    The state is one row a key; revisions of a publication day win by observation day and value, as in the batch join.
    """
    seen = stream.filter("publication_date is not null")
    best = F.max_by(F.struct("publication_date", "observation_date", "value"), F.struct("publication_date", "observation_date", "value"))
    return seen.groupBy(*keys).agg(best.alias("latest"), F.count(F.lit(1)).alias("n_observations")).select(*keys, "latest.*", "n_observations")
