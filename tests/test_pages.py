"""Pages read by expressions against the parser."""

import pytest
from pyspark.sql import functions as F

from habitscope.operators import text

NAMES = ["page_id", "url", "raw_title", "raw_date", "raw_markdown"]
HEAD = "<html><head><title>The &amp; page</title><script>var t='</p><article>';</script></head><body><nav><li>x</li></nav>"
ARTICLES = [
    "<article><h1>A <b>b</b></h1><p>one &lt;two&gt; &amp;lt;<p>next\n line<br>more</p>loose</article>",
    "<p>before<article class='x'>in<h2 id=\"a\">Sub</h2><ul><li>p<li>q</ul><blockquote>r</blockquote></article>after",
    "<ARTICLE><P>Upper</P></ARTICLE>",
    "<article></article><p>only the body</p>",
    "<article><p>a < b and c</p></article>",
    "<article><p title=\"x>y\">quoted</p></article>",
    "<article><p>&eacute;t&eacute; &#65;</p></article>",
    "<article><p>one</p></article><article><p>two</p></article>",
    "<main><p>in main</p></main>",
    "<h1>outside</h1><article><p>text</p></article>",
    "<article><time datetime='2024-01-02'>then</time><p>dated</p></article>",
    "<article><p>open <nav><li>menu</li></nav> again</p></article>",
    "<article><!-- <p>hidden</p> --><p>shown</p></article>",
    "<article><h1>never closed<p>x</p></article>",
    "<article><p>no end of the article",
]
PAGES = [*(HEAD + a + "<footer>&copy; f</footer></body></html>" for a in ARTICLES), "", None, "plain text"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://a/{i}", h) for i, h in enumerate(PAGES)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select(*NAMES).collect())


def test_simple_pages_are_as_parsed(pages):
    told = text.tokenise(pages).where("simple")
    simple = [r.page_id for r in told.select("page_id").collect()]
    assert {0, 1, 2} <= set(simple) and not {3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16, 17} & set(simple)
    assert rows_of(told) == rows_of(text.parse_pages(pages.where(F.col("page_id").isin(simple))))


def test_every_page_is_extracted_once(pages):
    key = lambda rows: [tuple(str(v) for v in r) for r in rows]
    assert sorted(key(rows_of(text.extract(pages).fillna("")))) == sorted(key(rows_of(text.parse_pages(pages).fillna(""))))
    assert text.extract(pages.limit(0)).count() == 0


def test_pages_of_the_tables_are_simple(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    told = text.tokenise(pages)
    assert told.where("not simple").count() == 0
    assert rows_of(told) == rows_of(text.parse_pages(pages))
