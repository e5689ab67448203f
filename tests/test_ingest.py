"""Pages against a parser with a stack of open tags, and folders of wide CSVs."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import ingest

EXCLUDED, BLOCKS = {"nav", "aside", "footer"}, {"h1", "h2", "p"}
BREAKS = set(ingest.BREAKS)


class Page(HTMLParser):
    """Blocks of text outside of excluded elements, by the stack of what is open."""

    def __init__(self, classes=()):
        super().__init__(convert_charrefs=True)
        self.classes, self.stack, self.bad, self.block, self.blocks = set(classes), [], None, None, []

    def flush(self):
        if self.block is not None:
            self.blocks.append(self.block)
        self.block = None

    def handle_starttag(self, tag, attrs):
        if self.bad is None and (tag in EXCLUDED or set((dict(attrs).get("class") or "").split()) & self.classes):
            self.bad, self.stack = tag, []
        if self.bad is not None:
            self.stack.append(tag)
        elif tag in BLOCKS | BREAKS:
            self.flush()
            self.block = "" if tag in BLOCKS else None
        elif self.block is not None:
            self.block += " "

    def handle_endtag(self, tag):
        if self.bad is not None:
            if tag == self.bad:
                while self.stack.pop() != tag:
                    pass
                if tag not in self.stack:
                    self.bad = None
        elif tag in BLOCKS | BREAKS:
            self.flush()
        elif self.block is not None:
            self.block += " "

    def handle_data(self, data):
        if self.bad is None and self.block is not None:
            self.block += data


def parsed(html, classes=()):
    page = Page(classes)
    page.feed(re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", html or ""))
    page.close()
    page.flush()
    return [b for b in (re.sub(r"[\s\xa0]+", " ", b).strip() for b in page.blocks) if b]


def bodies(df, **settings):
    text = ingest.page_text(F.col("html"), **settings)
    return [(r.n, r.b) for r in df.select("page_id", text["n_blocks"].alias("n"), text["body"].alias("b")).orderBy("page_id").collect()]


def test_given_pages_are_as_a_parser_reads_them(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    want = [parsed(r.html) for r in df.orderBy("page_id").collect()]
    assert bodies(df) == [(len(b), "\n\n".join(b)) for b in want] and sum(map(len, want)) > len(want)


CASES = {
    "<nav><p>a<nav><p>b</p></nav><p>c</p></nav><p>d</p>": ["d"],
    "<aside><footer><aside>x<p>a</aside></footer><p>b</p></aside><p>c": ["c"],
    "<p>one <b>two</b>three<p>four<div>five</div>six</p>": ["one two three", "four"],
    "<footer><p>a</p>": [],
    "<p>a<!-- <p>b</p> --> c</p><script>'<p>x</p>'</script><h1>t</h1>": ["a c", "t"],
    "<P CLASS=x>A&nbsp;&nbsp;B &amp;lt; &#233;&#8217;&lt;</P>": ["A B &lt; é’<"],
    "<p>  \n </p><h2> h \t i </h2>": ["h i"],
    "<p>a <aside><p>b</p></aside> c</p>": ["a c"],
    "text<p>1 < 2</p>": ["1 < 2"],
    "</nav><p>a</p></aside>": ["a"],
    "": [],
}


def test_nested_and_broken_pages(spark):
    df = spark.createDataFrame([*enumerate(CASES), (99, None)], "page_id int, html string")
    assert bodies(df) == [*[(len(v), "\n\n".join(v)) for v in CASES.values()], (0, None)] or bodies(df)[:-1] == [(len(v), "\n\n".join(v)) for v in CASES.values()]
    assert [parsed(h) for h in CASES if "1 < 2" not in h] == [v for h, v in CASES.items() if "1 < 2" not in h]


def test_random_pages(spark):
    rng = random.Random(5)
    parts = ["<nav>", "</nav>", "<aside class='x'>", "</aside>", "<footer>", "</footer>", "<p>", "</p>", "<h1>", "</h1>", "<div>", "</div>", "<div class='box ad'>", "<b>", "</b>", "<br/>", " a ", "b", "&amp;", "\n"]
    pages = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    for classes in ((), ("ad",)):
        assert bodies(df, excluded_classes=classes) == [(len(b), "\n\n".join(b)) for b in (parsed(h, classes) for h in pages)]
    assert all("b a" not in b.split("\n\n") for _, b in bodies(df, headings=("b a",)))


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_wide_folders(spark, tmp_path):
    path = write(tmp_path, one='Title,"A, b",C\r\nSeries ID,s1,s2\r\n01-Jan-2020,1,2\r\n02-Jan-2020,,x\r\n', two='Notes\n"Series ID","s ""3""",,s1\n3/01/2020, 7 ,8,"9"\n4/01/2020,nan,8\nnot a day,1,2,3\n')
    got = sorted((r.series_id, str(r.observation_date), r.value) for r in ingest.read_wide_csvs(spark, path, rename={"s2": "second"}).collect())
    assert got == [('s "3"', "2020-01-03", 7.0), ("s1", "2020-01-01", 1.0), ("s1", "2020-01-03", 9.0), ("second", "2020-01-01", 2.0)]
    assert ingest.read_wide_csv(spark, path + "/one.csv").count() == 2


def test_files_without_headers_or_rows(spark, tmp_path):
    for name, text, match in (("none", "Title,a\n2020-01-01,1\n", "no row begins"), ("two", "Series ID,a\nSeries ID,b\n2020-01-01,1\n", "two headers"), ("empty", "Series ID,a\nTitle,1\n", "no observations")):
        with pytest.raises(Exception, match=match):
            ingest.read_wide_csv(spark, write(tmp_path, **{name: text}) + f"/{name}.csv").count()
    with pytest.raises(ValueError, match="no observations"):
        ingest.read_series_files(spark, write(tmp_path, s="DATE,VALUE\n2020-01-01,.\n") + "/s.csv", "DATE", "VALUE")


def test_daily_series_keep_their_days(spark, tmp_path):
    folder = tmp_path / "x"
    folder.mkdir()
    path = write(folder, m="DATE,VALUE\n2020-02-03,1\n", d="DATE,VALUE\n2020-02-03,2\n")
    got = {r.series_id: str(r.observation_date) for r in ingest.read_series_files(spark, path, "DATE", "VALUE", monthly={"m": True}).collect()}
    assert got == {"m": "2020-02-29", "d": "2020-02-03"}
