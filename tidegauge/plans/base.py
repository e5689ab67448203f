"""What the plans share: the registry, and frames of the test tables in the library's shapes, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.features import Panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a plan, and the SQL that should give the same rows."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel (entity, event_date, value): customers' order totals by day."""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity"), day.alias("event_date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


ORDERS = "o AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS event_date, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"
PANEL = Panel(("entity",), ("event_date",))
W = "(PARTITION BY entity ORDER BY event_date)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long observations (entity, series_id, observation_date, publication_date, value): users' daily mean by event type, public two days later."""
    day = F.to_date("ts")
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("series_id"), day.alias("observation_date")).agg(F.round(F.avg("value"), 4).alias("value"))
    return rows.select("entity", "series_id", "observation_date", F.date_add("observation_date", 2).alias("publication_date"), "value")


EVENTS = """l AS (SELECT user_id AS entity, event_type AS series_id, CAST(ts AS DATE) AS observation_date, CAST(ts AS DATE) + 2 AS publication_date,
                         round(avg(value), 4) AS value FROM events GROUP BY 1, 2, 3)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions (entity, event_date, y_true, y_pred, y_market, p): the sign of customers' order changes, held against the one before."""
    p = PANEL.window
    delta = F.col("value") - F.lag("value").over(p)
    sign = F.when(F.col("delta") < -50000, "cut").when(F.col("delta") > 50000, "hike").otherwise("hold")
    rows = orders(spark, sf_dir).withColumn("delta", delta).filter("delta is not null").withColumn("y_true", sign)
    market = F.when(F.col("value") > 200000, "hike").when(F.col("value") < 50000, "cut").when(F.col("value") > 60000, "hold")
    chance = F.round(F.pmod(F.col("value"), F.lit(1000.0)) / 1000, 6)
    return rows.select("entity", "event_date", "value", "y_true", F.lag("y_true").over(p).alias("y_pred"), market.alias("y_market"), chance.alias("p")).filter("y_pred is not null")


CALLS = (
    ORDERS
    + """, dl AS (SELECT *, value - lag(value) OVER (PARTITION BY entity ORDER BY event_date) AS delta FROM o),
    sg AS (SELECT *, CASE WHEN delta < -50000 THEN 'cut' WHEN delta > 50000 THEN 'hike' ELSE 'hold' END AS y_true FROM dl WHERE delta IS NOT NULL),
    c AS (SELECT * FROM (SELECT entity, event_date, value, y_true, lag(y_true) OVER (PARTITION BY entity ORDER BY event_date) AS y_pred,
          CASE WHEN value > 200000 THEN 'hike' WHEN value < 50000 THEN 'cut' WHEN value > 60000 THEN 'hold' END AS y_market,
          round((value % 1000) / 1000, 6) AS p FROM sg) WHERE y_pred IS NOT NULL)"""
)
LABELS = ["cut", "hike", "hold"]
