"""Plans over files, pages and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import lexicon as L
from tidegauge.operators import quality
from tidegauge.plans.base import EVENTS, events, query, table
from tidegauge.sources import ingest, sinks

TYPES = ["click", "error", "purchase", "signup", "view"]
#: A lexicon of all words of the table ``benchmark``: a word is in the first category of its length's remainder, and if it starts with a vowel also in the next.
CATEGORIES = ["positive", "negative", "uncertain", "litigious", "strong_modal", "weak_modal", "constraining"]
_LEX = "w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM benchmark), lx AS (SELECT word, c.category FROM w JOIN (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES)) + f") c(i, category) ON i = length(word) % 7 OR (i = (length(word) + 1) % 7 AND word[1] IN ('a', 'e', 'i', 'o', 'u')))"


def _lexicon(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(L.tokens(F.col("text"))).alias("word")).distinct()
    own = F.array(F.pmod(F.length("word"), F.lit(7)), F.when(F.substring("word", 1, 1).isin(*"aeiou"), F.pmod(F.length("word") + 1, F.lit(7))))
    return words.select("word", F.explode(F.array_compact(own)).alias("i")).select("word", F.get(F.array(*map(F.lit, CATEGORIES)), F.col("i")).alias("category"))


_TOKENS = "tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM documents)"


@query("a2_wide_to_long", """SELECT series_id, CAST(o_orderdate AS DATE) AS observation_date, value FROM (SELECT o_orderdate, 'price' AS series_id, o_totalprice AS value FROM orders UNION ALL SELECT o_orderdate, 'customer', CASE WHEN o_custkey % 4 > 0 THEN CAST(o_custkey AS DOUBLE) END FROM orders) WHERE value IS NOT NULL""")
def _(spark, d):
    day = F.to_date("o_orderdate")
    wide = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("Title"), F.col("o_totalprice").cast("string").alias("P"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey").cast("string")).otherwise(".").alias("C"))
    return ingest.wide_to_long(wide, "Title", {"P": "price", "C": "customer"}, "dd/MM/yyyy", "yyyy-MM-dd")


@query("a2_wide_folder", """SELECT CASE WHEN y % 2 = 0 THEN s || '' ELSE 'odd_' || s END AS series_id, observation_date, value FROM (SELECT year(o_orderdate) AS y, 'price' AS s, CAST(o_orderdate AS DATE) AS observation_date, o_totalprice AS value FROM orders
    UNION ALL SELECT year(o_orderdate), 'customer', CAST(o_orderdate AS DATE), CASE WHEN o_custkey % 4 > 0 THEN CAST(o_custkey AS DOUBLE) END FROM orders) WHERE value IS NOT NULL""")  # fmt: skip
def _(spark, d):
    """A folder with a file a year: titles, a row of ids, and columns whose order and names differ from file to file."""
    rows = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.date_format("o_orderdate", "d/MM/yyyy").alias("t"), F.col("o_totalprice").cast("string").alias("p"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey").cast("string")).otherwise("n/a").alias("c"))
    even = F.col("y") % 2 == 0
    data = rows.select("y", F.when(even, F.concat_ws(",", "t", "p", "c")).otherwise(F.concat_ws(",", "t", "c", F.lit('"a, ""b"""'), "p")).alias("line"))
    heads = rows.select("y").distinct().select("y", F.explode(F.when(even, F.array(F.lit('Title,"Prices, all",Customers'), F.lit("Series ID,price,customer"))).otherwise(F.array(F.lit("Title,Customers,,Prices"), F.lit("Series ID, odd_customer ,,odd_price")))).alias("line"))
    path = sinks.workspace(spark, "folder")
    heads.unionByName(data).repartition("y").write.partitionBy("y").text(path)
    return ingest.read_wide_csvs(spark, path).drop("file")


@query("a4_sdmx", """SELECT CAST(user_id AS VARCHAR) AS series_id, ['p0', 'p1', 'p2', 'p3', 'p4'][1 + event_id % 5] AS period, CAST(round(value, 3) AS DOUBLE) AS value FROM events WHERE event_id % 6 < 5""")
def _(spark, d):
    key = F.concat(F.lit("0:0:"), (F.col("event_id") % F.when(F.col("event_id") % 6 < 5, 5).otherwise(1)).cast("string"))
    key = F.when(F.col("event_id") % 6 < 5, key).otherwise(F.lit("0:0:9"))
    codes = F.array(*[F.lit(f"p{i}") for i in range(5)])
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("series_id"), F.to_json(F.create_map(key, F.array(F.round("value", 3)))).alias("observations"), codes.alias("codes"))
    return ingest.sdmx_observations(rows, "observations", "codes")


@query("a5_chart_points", """SELECT CAST(user_id AS VARCHAR) AS series_id, CAST(ts AS DATE) AS observation_date, value FROM events WHERE value IS NOT NULL""")
def _(spark, d):
    day = F.col("ts").cast("timestamp")  # a chart a series and day, so that no cell grows with a series' length
    rows = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("series_id"), F.to_date(day)).agg(F.sort_array(F.collect_list(F.struct(F.unix_seconds(day).alias("s"), "value"))).alias("x"))
    return ingest.chart_points(rows.select("series_id", F.col("x.s").alias("timestamps"), F.col("x.value").alias("closes")), "timestamps", "closes", "UTC")


@query("a9_futures_curve", """SELECT CAST(l_shipdate AS DATE) AS observation_date, 'ib_' || strftime(l_shipdate + INTERVAL 1 MONTH, '%Y_%m') AS series_id, round(100 - l_tax * 100, 6) AS value FROM lineitem WHERE l_quantity > 5""")
def _(spark, d):
    ship = F.to_date("l_shipdate")
    rows = table(spark, d, "lineitem").select(F.add_months(F.trunc(ship, "MM"), 1).alias("contract_month"), F.when(F.col("l_quantity") > 5, F.col("l_tax") * 100).alias("rate"), ship.alias("traded"))
    return ingest.futures_curve(rows).withColumn("value", F.round("value", 6))


@query("a10_to_wide", f"""WITH {EVENTS} SELECT entity, observation_date, {', '.join(f"max(value) FILTER (series_id = '{t}') AS {t}" for t in TYPES)}, min(publication_date) AS publication_date, CAST(count(DISTINCT series_id) FILTER (value IS NOT NULL) AS INTEGER) AS n_series FROM l GROUP BY 1, 2""")
def _(spark, d):
    return ingest.to_wide(events(spark, d), TYPES, ["entity"])


@query("a15_page_text")
def _(spark, d):
    text = ingest.page_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", text["title"].alias("title"), text["n_blocks"].alias("n_blocks"), text["body"].alias("body"))


@query("a16_attribution", """SELECT page_id, CASE WHEN regexp_matches(url, '/en/') THEN 'english' WHEN regexp_matches(url, '/(fr|es)/') THEN 'romance' WHEN regexp_matches(url, '^https?://m\\.') THEN 'mobile' END AS kind FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", ingest.attributed(F.col("url"), [("/en/", "english"), ("/(fr|es)/", "romance"), (r"^https?://m\.", "mobile")]).alias("kind"))


@query("a18_links", """SELECT link, min(page_id) AS first_page FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages) WHERE regexp_matches(link, '^/[A-Za-z]+$') GROUP BY 1""")
def _(spark, d):
    return ingest.links(table(spark, d, "pages"), r"^/[A-Za-z]+$")


@query("f22_null_counts", """SELECT unnest(['o_orderkey', 'cheap']) AS column_name, unnest([CAST(0 AS HUGEINT), sum(CAST(o_totalprice > 100000 AS INTEGER))]) AS n_null, unnest([count(*), count(*)]) AS n FROM orders""")
def _(spark, d):
    return quality.null_counts(table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") <= 100000, F.col("o_totalprice")).alias("cheap")))


@query("h1_tokens", f"WITH {_TOKENS} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tk GROUP BY 1")
def _(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(L.tokens(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query("h3_h6_lexicon_scores", f"""WITH {_LEX}, {_TOKENS}, k AS (SELECT doc_id, {', '.join(f"count(*) FILTER (word IN (SELECT word FROM lx WHERE category = '{c}')) AS {c}" for c in CATEGORIES)}, count(*) AS n_tokens FROM tk GROUP BY 1),
    z AS (SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, {', '.join(f'coalesce({c}, 0) AS {c}' for c in CATEGORIES)} FROM documents LEFT JOIN k USING (doc_id))
    SELECT *, {', '.join(f'round(coalesce(1000.0 * {c} / nullif(n_tokens, 0), 0), 6) AS {c}_per_1000, round(coalesce(1.0 * {c} / nullif(n_tokens, 0), 0), 6) AS {c}_ratio' for c in CATEGORIES)}, round((positive - negative) / nullif(positive + negative, 0), 6) AS tone FROM z""")  # fmt: skip
def _(spark, d):
    rows = L.scores(L.category_counts(table(spark, d, "documents"), _lexicon(spark, d), CATEGORIES), CATEGORIES)
    return rows.select("doc_id", "n_tokens", *CATEGORIES, *[F.round(c, 6).alias(c) for c in rows.columns[2 + len(CATEGORIES) :]])


@query("h2_compact_lexicon", """WITH m AS (SELECT lower(p_brand) AS word, arg_min(p_size % 3, p_partkey) AS a, arg_min(p_partkey % 2, p_partkey) AS b FROM part GROUP BY 1)
    SELECT word, 'a' AS category FROM m WHERE a <> 0 UNION ALL SELECT word, 'b' FROM m WHERE b <> 0""")  # fmt: skip
def _(spark, d):
    master = table(spark, d, "part").select(F.col("p_brand").alias("word"), F.col("p_partkey").alias("line"), (F.col("p_size") % 3).cast("long").alias("a"), (F.col("p_partkey") % 2).alias("b"))
    return L.compact(master, ["a", "b"])
