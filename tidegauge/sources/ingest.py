"""Readers that shape published files into long observations, and pages into text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.scalars import finite


def parse_day(c: Column, *formats: str) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats])


def wide_to_long(df: DataFrame, date_col: str, series: dict[str, str], *formats: str) -> DataFrame:
    """(series_id, observation_date, value) of a wide table of text: one column a series, named by ``series``; what isn't a day or number is dropped."""
    text = df.select(F.col(f"`{date_col}`").cast("string").alias("_d"), *[F.col(f"`{c}`").cast("string").alias(s) for c, s in series.items()])
    long = text.unpivot("_d", list(series.values()), "series_id", "_v")
    return long.select("series_id", parse_day(F.trim("_d"), *formats).alias("observation_date"), finite(F.trim("_v").try_cast("double")).alias("value")).dropna()


DAYS = ("dd-MMM-yyyy", "d/MM/yyyy", "yyyy-MM-dd")


def cells(line: Column) -> Column:
    """The cells of a line of CSV, trimmed; cells in double quotes may hold commas and doubled quotes."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(\s*"[^"]*(?:""[^"]*)*"\s*|[^,]*)'), F.lit(1))
    return F.transform(F.transform(found, lambda c: F.trim(c)), lambda c: F.when(c.startswith('"') & (F.length(c) > 1), F.trim(F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')))).otherwise(c))


def read_wide_csvs(spark: SparkSession, path: str, id_row: str = "Series ID", formats: tuple[str, ...] = DAYS, rename: dict[str, str] | None = None) -> DataFrame:
    """(file, series_id, observation_date, value) of all CSVs under a path, each with its own columns.

    In each file the row whose first cell is ``id_row`` names the columns' series; rows with a day in the first cell are data, all others titles. The headers are a table of one
    row a file, joined to the lines by file, so files are read in parallel and nothing comes to the driver. A file with data but without such a row is an error, and so is
    one with two that differ. Cells that aren't finite numbers, and columns without a name, are dropped. rename: published ids to own ones; others keep theirs. A record is one line.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), cells(F.col("value")).alias("c"))
    lines = lines.withColumn("first", F.get("c", F.lit(0)))
    heads = lines.filter(F.col("first") == id_row).groupBy("file").agg(F.min("c").alias("names"), F.max("c").alias("last"))
    day = parse_day(F.col("first"), *formats)
    data = lines.filter(F.col("first") != id_row).withColumn("observation_date", day).filter("observation_date is not null").join(heads, "file", "left")
    fine = F.when(F.col("names").isNull(), F.raise_error(F.concat(F.lit(f"no row begins with {id_row!r} in "), F.col("file")))).when(F.col("names") != F.col("last"), F.raise_error(F.concat(F.lit("two headers in "), F.col("file"))))
    long = data.select("file", "observation_date", fine.cast("string").alias("_ok"), F.explode(F.slice(F.arrays_zip(F.col("names").alias("s"), F.col("c").alias("v")), 2, 1 << 30)).alias("x")).filter("_ok is null")
    own = F.col("x.s")
    if rename:
        own = F.coalesce(F.create_map(*[F.lit(x) for pair in rename.items() for x in pair])[own], own)
    return long.filter("x.s <> ''").select("file", own.alias("series_id"), "observation_date", finite(F.col("x.v").try_cast("double")).alias("value")).dropna()


def read_wide_csv(spark: SparkSession, path: str, id_row: str = "Series ID", formats: tuple[str, ...] = DAYS) -> DataFrame:
    """Long observations of one CSV with title rows above; see :func:`read_wide_csvs`. A file without rows of series is an error."""
    return not_empty(read_wide_csvs(spark, path, id_row, formats).drop("file"), f"observations below a row that begins with {id_row!r} in {path}")


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """df; an error if it has no rows, which one row's read tells."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def read_series_files(spark: SparkSession, path: str, date_col: str, value_col: str, null: str = ".", monthly: bool | dict[str, bool] = True) -> DataFrame:
    """Long observations of one CSV a series, the file's name being the series; days of monthly series snap to month ends. No observations at all are an error.

    monthly: for all series, or by series (those not named are daily).
    """
    rows = spark.read.option("header", True).option("nullValue", null).csv(path).select("*", F.regexp_replace("_metadata.file_name", r"\.csv.*$", "").alias("series_id"))
    day = parse_day(F.col(date_col), "yyyy-MM-dd")
    snap = F.lit(monthly) if isinstance(monthly, bool) else F.col("series_id").isin([k for k, v in monthly.items() if v])
    out = rows.select("series_id", F.when(snap, F.last_day(day)).otherwise(day).alias("observation_date"), finite(F.col(value_col).try_cast("double")).alias("value")).dropna()
    return not_empty(out, f"observations in {path}")


def sdmx_observations(df: DataFrame, json_col: str, codes_col: str) -> DataFrame:
    """(series_id, period, value) from a map of observations keyed "0:0:k", whose last part counts an array of period codes from 0."""
    seen = F.from_json(json_col, "map<string,array<double>>")
    rows = df.select("series_id", codes_col, F.explode(seen).alias("key", "values"))
    at = F.element_at(F.split("key", ":"), -1).try_cast("int")
    return rows.select("series_id", F.get(F.col(codes_col), at).alias("period"), F.get("values", F.lit(0)).alias("value")).dropna()


def chart_points(df: DataFrame, seconds: str, values: str, zone: str = "Australia/Sydney") -> DataFrame:
    """(series_id, observation_date, value) from parallel arrays of UTC seconds and values; an error if their lengths differ, null values dropped."""
    same = F.assert_true(F.size(seconds) == F.size(values), F.lit("arrays differ in length"))
    rows = df.select("series_id", same.alias("_ok"), F.explode(F.arrays_zip(F.col(seconds).alias("s"), F.col(values).alias("v"))).alias("p")).filter("_ok is null")
    return rows.select("series_id", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("p.s"), zone)).alias("observation_date"), F.col("p.v").alias("value")).filter("value is not null")


def futures_curve(df: DataFrame) -> DataFrame:
    """(observation_date, series_id, value) of contracts: ib_YYYY_MM of the contract's month, 100 less the rate; rows with a null are dropped."""
    rows = df.dropna(subset=["contract_month", "rate", "traded"])
    return rows.select(F.col("traded").alias("observation_date"), F.concat(F.lit("ib_"), F.date_format("contract_month", "yyyy_MM")).alias("series_id"), (100 - F.col("rate")).alias("value"))


def to_wide(obs: DataFrame, series: list[str], by: list[str] | None = None) -> DataFrame:
    """One row a day (and group): the value of each series named, in that order, first publication, and how many series have a value; one aggregation."""
    by = [*(by or []), "observation_date"]
    own = [F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(s) for s in series]
    wide = obs.groupBy(*by).agg(*own, F.min("publication_date").alias("publication_date"))
    n = sum((F.col(f"`{s}`").isNotNull().cast("int") for s in series), F.lit(0))
    return wide.select(*by, *[F.col(f"`{s}`") for s in series], "publication_date", n.alias("n_series"))


def in_window(targets: DataFrame, at: str, window: DataFrame, link: str | None = None) -> DataFrame:
    """The targets whose ``at`` lies between since and until (both inclusive) of the one row of ``window``; those without an ``at``, or with an empty or null link if one is named, are left out."""
    if link:
        targets = targets.filter(F.length(F.trim(link)) > 0)
    return targets.join(F.broadcast(window.select("since", "until")), F.col(at).between(F.col("since"), F.col("until"))).drop("since", "until")


#: Elements whose text doesn't count, and those that hold or end a block of text.
EXCLUDED, BLOCKS, BREAKS = ("nav", "aside", "footer"), ("h1", "h2", "p"), ("div", "ul", "ol", "table", "section", "article", "main", "header", "form", "body", "html")
#: A comment, a whole script or style, a tag, a text, or a lone bracket.
MARKUP = r"(?is)<!--.*?(?:-->|$)|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|$)|</?[a-z][^>]*>|<![^>]*>|[^<]+|<"
#: Named references that pages use most; the ampersand comes last.
NAMED = {"&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def unescaped(c: Column) -> Column:
    """A text with decimal references and the usual named ones replaced by their characters; others stay as they are."""
    number = lambda r: r.try_cast("int")
    sound = lambda r: number(r).between(1, 0xD7FF) | number(r).between(0xE000, 0x10FFFF)
    refs = F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#(\d{1,7});"), F.lit(1))), sound)
    out = F.aggregate(refs, c, lambda t, r: F.replace(t, F.concat(F.lit("&#"), r, F.lit(";")), F.decode(F.unhex(F.lpad(F.hex(number(r)), 8, "0")), "UTF-32")))
    for name, own in NAMED.items():
        out = F.replace(out, F.lit(name), F.lit(own))
    return out


def page_text(html: Column, excluded: tuple[str, ...] = EXCLUDED, excluded_classes: tuple[str, ...] = (), headings: tuple[str, ...] = ()) -> dict[str, Column]:
    """title, n_blocks and body of a page: headings and paragraphs outside of excluded elements and classes, joined by blank lines.

    Pages are cut into tags and texts, and those are folded over a state: the excluded element that is open and how deeply its name is nested in itself, the block that is open and its text so
    far, and the blocks before. So an excluded element goes whole, whatever is nested in it, up to its own end tag or the page's end. Scripts, styles and comments are no text. A
    block ends at its end tag, at the next block or at an element that breaks text; text outside of blocks doesn't count. White space collapses, references are replaced, and
    blocks that equal one of ``headings`` are left out. Null pages have a null title and no blocks.
    """
    tag = lambda t: F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    clean = lambda c: F.trim(F.regexp_replace(unescaped(c), r"[\s\u00a0]+", " "))
    # a state's text begins with the name of its block and a colon, so that "" is no block
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("deep"), F.lit("").alias("text"), F.array().cast("array<string>").alias("done"))

    def flushed(s: Column) -> Column:
        return F.when(s["text"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["text"])))

    def step(s: Column, t: Column) -> Column:
        name = F.when(t.rlike(r"^</?[A-Za-z]"), tag(t)).otherwise("")
        ends = t.startswith("</")
        is_text = ~t.rlike(r"(?s)^<[A-Za-z/!]")
        outside = s["deep"] == 0
        bad = name.isin(*excluded)
        if excluded_classes:
            own = F.split(F.regexp_extract(t, r"""(?i)\bclass\s*=\s*["']?([^"'>]*)""", 1), r"\s+")
            bad = bad | F.arrays_overlap(own, F.array(*map(F.lit, excluded_classes)))
        bad = outside & (name != "") & ~ends & bad & ~t.rlike("/>$")
        deep = F.when(bad, 1).when(outside, 0).when(name == s["out"], s["deep"] + F.when(ends, -1).otherwise(1)).otherwise(s["deep"])
        block = name.isin(*BLOCKS)
        closes = outside & ~bad & (block | name.isin(*BREAKS))
        opens = closes & block & ~ends
        text = F.when(opens, ">").when(closes, "").when(outside & (s["text"] != "") & is_text, F.concat(s["text"], t)).when(outside & (s["text"] != "") & (name != ""), F.concat(s["text"], F.lit(" "))).otherwise(s["text"])
        return F.struct(F.when(bad, name).otherwise(s["out"]).alias("out"), deep.alias("deep"), text.alias("text"), F.when(closes, flushed(s)).otherwise(s["done"]).alias("done"))

    found = F.aggregate(F.regexp_extract_all(html, F.lit(MARKUP), F.lit(0)), start, step, flushed)
    blocks = F.filter(F.transform(found, lambda b: clean(F.substring(b, F.lit(2), F.length(b)))), lambda b: (b != "") & ~b.isin(*headings) if headings else b != "")
    title = F.nullif(clean(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"(?s)<[^>]*>", " ")), F.lit(""))
    return {"title": title, "n_blocks": F.coalesce(F.size(blocks), F.lit(0)), "body": F.array_join(blocks, "\n\n")}


def release_date(page: Column, rules: list[tuple[str, str]]) -> Column:
    """The day a page was released on: the first pattern, in order, whose first group is a day in its format; null if none is."""
    return F.coalesce(*[parse_day(F.nullif(F.regexp_extract(page, pattern, 1), F.lit("")), form) for pattern, form in rules])


#: Words with which roles begin, and honours after names, as published pages write them.
ROLE_LEADS, HONOURS = ("Governor", "Deputy Governor", "Assistant Governor", "Head", "Chief", "Secretary", "Director"), ("AO", "AC", "AM", "OAM")


def speaker_and_role(author: Column, leads: tuple[str, ...] = ROLE_LEADS, honours: tuple[str, ...] = HONOURS) -> dict[str, Column]:
    """speaker and role of an author line: the role begins at its first lead word after the name; footnote marks and honours after the name go. Without a lead all of it is the speaker."""
    text = F.trim(F.regexp_replace(F.regexp_replace(author, r"\[\s*\*\s*\]|\*", " "), r"[\s\u00a0]+", " "))
    split = rf"^(.+?) ((?:{'|'.join(sorted(leads, key=len, reverse=True))})\b.*)$"
    found = text.rlike(split)
    name = F.regexp_replace(F.regexp_extract(text, split, 1), rf"(?: (?:{'|'.join(honours)}))+$", "")
    return {"speaker": F.nullif(F.when(found, name).otherwise(text), F.lit("")), "role": F.when(found, F.regexp_extract(text, split, 2))}


def links(pages: DataFrame, pattern: str, key: str = "page_id") -> DataFrame:
    """(link, first page) of hrefs that match, each once, by its first page."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""href=["']([^"']+)["']"""), F.lit(1))
    rows = pages.select(key, F.explode(hrefs).alias("link")).filter(F.col("link").rlike(pattern))
    return rows.groupBy("link").agg(F.min(key).alias("first_page"))


def attributed(title: Column, rules: list[tuple[str, str]]) -> Column:
    """The name that the first pattern found in a title stands for; null if none is."""
    return F.coalesce(*[F.when(title.rlike(pattern), name) for pattern, name in rules])
