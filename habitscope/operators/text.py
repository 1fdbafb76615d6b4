"""Article pages: URLs, titles, dates, Markdown bodies, output names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitscope.session import cut
from habitscope.sources.store import write_table

TITLE_SUFFIX = r"(?i)\s*[|–—-]\s*[^|–—-]*$"
MINIMUM_BODY = 20
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def canonical_url(url: Column, language: str = "english") -> Column:
    """https, lower-case host, no port, fragment or trailing slash, and only the language in the query."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "/+$", "")
    return F.when(host != "", F.concat(F.lit("https://"), host, path, F.lit(f"?l={language}")))


def article_id(url: Column, pattern: str = r"/(\d+)(?:$|[/?#])") -> Column:
    found = F.regexp_extract(url, pattern, 1)
    return F.when(found == "", "unknown").otherwise(found)


def article_urls(pages: DataFrame, language: str = "english", path: str = r"/\d+$") -> DataFrame:
    """Pages whose path names an article, one row per canonical URL: the first page by id."""
    plain = pages.withColumn("canonical", canonical_url(F.col("url"), language)).where(
        F.regexp_replace("canonical", r"\?.*$", "").rlike(path)
    )
    return plain.groupBy("canonical").agg(F.min("page_id").alias("page_id")).withColumn(
        "article_id", article_id(F.col("canonical"))
    )


# Markdown prefixes of the block tags, fixed values.
MARKS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "p": "", "li": "- ", "blockquote": "> "}
_BLOCK = "|".join(MARKS)
_ARTICLE = r"(?is)<article(?:\s[^<>]*)?>(.*?)</article\s*>"
_HEAD = r"(?is)<h1(?:\s[^<>]*)?>(.*?)</h1\s*>"
# What the expressions do not follow inside an article: other markup than plain tags, other entities than the
# five below, quoted brackets, and elements with a content of their own.
_INVOLVED = (
    r"(?i)<(?!/?[a-z])|<[^>]*<|&(?!(?:amp|lt|gt|quot|#39);)|=\s*[\"'][^\"'<>]*>"
    r"|</?(?:script|style|nav|footer|header|noscript|svg|button|main|time|title|textarea|iframe|xmp|noembed|noframes|plaintext|math)\b"
)
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def _plain(markup: Column) -> Column:
    """Text of a stretch of markup: tags are blanks, entities characters, blanks single."""
    out = F.regexp_replace(markup, "<[^>]*>", " ")
    for entity, sign in _ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def _blocks(article: Column) -> Column:
    """Markdown blocks: a tag of MARKS opens one, and the next such tag, opened or closed, ends it."""
    opened = F.regexp_replace(article, rf"(?i)<({_BLOCK})(?:\s[^>]*)?>", "\u0001$1\u0002")
    parts = F.split(F.regexp_replace(opened, rf"(?i)</(?:{_BLOCK})\s*>", "\u0001"), "\u0001")
    prefix = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])
    each = F.transform(
        F.filter(parts, lambda x: F.contains(x, F.lit("\u0002"))),
        lambda x: F.struct(
            F.lower(F.substring_index(x, "\u0002", 1)).alias("tag"), _plain(F.substring_index(x, "\u0002", -1)).alias("text")
        ),
    )
    return F.transform(F.filter(each, lambda x: x["text"] != ""), lambda x: F.concat(F.element_at(prefix, x["tag"]), x["text"]))


def tokenise(pages: DataFrame) -> DataFrame:
    """Title, Markdown and ``simple`` of each page, by expressions on its tags, without a parser.

    A page is simple where the expressions give what the parser gives: one article of plain tags with some text, at
    most one first heading, inside it, one title, and no meta or time tags that name a title or date. Title and
    Markdown of other pages mean nothing. A null page is not simple.
    """
    html = F.regexp_replace("html", r"(?is)<(script|style)(?:\s[^>]*)?>.*?</\1\s*>|<!--.*?-->", " ")
    article, head = F.regexp_extract("clean", _ARTICLE, 1), F.regexp_extract("article", _HEAD, 1)
    page_title = F.regexp_extract("clean", r"(?is)<title>(.*?)</title\s*>", 1)
    count = lambda tag: F.regexp_count(F.col("clean"), F.lit(rf"(?i)<{tag}\b"))
    found = (
        pages.select("page_id", "url", "html", html.alias("clean"))
        .withColumn("article", article)
        .withColumn("page_title", page_title)
        .withColumn("blocks", _blocks(F.col("article")))
    )
    simple = (
        (count("article") == 1)
        & (count("h1") == F.regexp_count(F.col("article"), F.lit(r"(?i)<h1\b")))
        & (count("h1") <= 1)
        & (count("h1") == F.regexp_count(F.col("article"), F.lit(r"(?i)</h1\s*>")))
        & (count("title") == 1)
        & ~F.col("clean").rlike(r"(?i)<time\b|<meta\s[^>]*(?:property|name|itemprop)\s*=|[\u0001\u0002]")
        & ~F.col("article").rlike(_INVOLVED)
        & ~F.col("page_title").rlike(r"<|&(?!(?:amp|lt|gt|quot|#39);)")
        & (F.size("blocks") > 0)
    )
    title = F.coalesce(F.nullif(_plain(head), F.lit("")), F.nullif(_plain(F.col("page_title")), F.lit("")), F.lit("Untitled"))
    return found.select(
        "page_id",
        "url",
        "html",
        F.coalesce(simple, F.lit(False)).alias("simple"),
        title.alias("raw_title"),
        F.lit(None).cast("string").alias("raw_date"),
        F.array_join("blocks", "\n\n").alias("raw_markdown"),
    )


def extract(pages: DataFrame) -> DataFrame:
    """Title, raw date and Markdown of each page: simple pages by expressions, the others by the parser.

    What the expressions give is written once, so that neither branch evaluates them again; the HTML of simple pages
    is not written.
    """
    told = cut(tokenise(pages).withColumn("html", F.when(~F.col("simple"), F.col("html"))))
    names = ["page_id", "url", "raw_title", "raw_date", "raw_markdown"]
    return told.where("simple").select(*names).unionByName(parse_pages(told.where(~F.col("simple"))))


def parse_pages(pages: DataFrame) -> DataFrame:
    """Title, raw date and Markdown of each page, parsed from the whole HTML.

    Blocks are taken from the article, else the main part, else the whole body; a block ends
    where the next one starts.  Parsing is per page and independent, so any split of the pages
    over tasks gives the same rows.
    """

    def parse(batches):
        from html.parser import HTMLParser

        import pandas as pd

        skipped = {"script", "style", "nav", "footer", "header", "noscript", "svg", "button"}
        marks = MARKS
        meta_titles = (("property", "og:title"), ("name", "twitter:title"))
        meta_dates = (("property", "article:published_time"), ("name", "date"), ("itemprop", "datePublished"))

        class Page(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.metas, self.titles, self.heads, self.times = {}, [], [], []
                self.blocks = {"article": [], "main": [], "body": []}
                self.open, self.skip, self.depth = None, 0, {"article": 0, "main": 0}
                self.in_title, self.in_time, self.head = False, False, None

            def close_block(self):
                if self.open is None:
                    return
                tag, words, zones = self.open
                self.open = None
                text = " ".join(" ".join(words).split())
                if text:
                    for zone in zones:
                        self.blocks[zone].append(marks[tag] + text)

            def handle_starttag(self, tag, attrs):
                values = dict(attrs)
                if tag == "meta":
                    for key in ("property", "name", "itemprop"):
                        if values.get(key) and values.get("content"):
                            self.metas.setdefault((key, values[key]), values["content"].strip())
                if tag == "title":
                    self.in_title = True
                if tag == "time":
                    self.in_time = True
                    if values.get("datetime"):
                        self.times.append(values["datetime"])
                if tag in skipped:
                    self.skip += 1
                    return
                if tag in self.depth:
                    self.depth[tag] += 1
                if tag == "h1":
                    self.head = []
                if tag in marks and not self.skip:
                    self.close_block()
                    zones = ["body"] + [z for z in ("article", "main") if self.depth[z]]
                    self.open = (tag, [], zones)

            def handle_endtag(self, tag):
                if tag == "title":
                    self.in_title = False
                if tag == "time":
                    self.in_time = False
                if tag in skipped:
                    self.skip = max(0, self.skip - 1)
                    return
                if tag == "h1" and self.head is not None:
                    self.heads.append(" ".join(" ".join(self.head).split()))
                    self.head = None
                if tag in marks or tag in self.depth:
                    self.close_block()
                if tag in self.depth:
                    self.depth[tag] = max(0, self.depth[tag] - 1)

            def handle_data(self, data):
                if self.in_title:
                    self.titles.append(data)
                if self.skip:
                    return
                if self.in_time and data.strip():
                    self.times.append(data.strip())
                if self.head is not None:
                    self.head.append(data)
                if self.open is not None:
                    self.open[1].append(data)

        def one(html):
            page = Page()
            page.feed(html or "")
            page.close()
            page.close_block()
            title = next((page.metas[k] for k in meta_titles if k in page.metas), None)
            title = title or next((h for h in page.heads if h), None) or " ".join("".join(page.titles).split())
            date = next((page.metas[k] for k in meta_dates if k in page.metas), None)
            date = date or (page.times[0] if page.times else None)
            blocks = page.blocks["article"] or page.blocks["main"] or page.blocks["body"]
            return title or "Untitled", date, "\n\n".join(blocks)

        for batch in batches:
            parsed = [one(h) for h in batch["html"]]
            yield pd.DataFrame(
                {
                    "page_id": batch["page_id"],
                    "url": batch["url"],
                    "raw_title": [p[0] for p in parsed],
                    "raw_date": [p[1] for p in parsed],
                    "raw_markdown": [p[2] for p in parsed],
                }
            )

    return pages.select("page_id", "url", "html").mapInPandas(
        parse, "page_id bigint, url string, raw_title string, raw_date string, raw_markdown string"
    )


def strip_suffix(title: Column, site: str) -> Column:
    """Title without a trailing site name after a dash or bar."""
    return F.trim(F.regexp_replace(title, rf"(?i)\s*[|–—-]\s*{site}\s*$", ""))


def normal_date(raw: Column) -> Column:
    """ISO date of an ISO stamp, of 'Month D, YYYY', or of such a date inside a text; else the text."""
    text = F.trim(raw)
    iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:$|[T ]\d{2}:\d{2})", 1)
    named = F.regexp_extract(text, rf"((?:{MONTHS}|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\.? \d{{1,2}}, \d{{4}})", 1)
    parsed = F.coalesce(
        F.try_to_timestamp(F.nullif(iso, F.lit("")), F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(F.nullif(named, F.lit("")), F.lit("MMMM d, yyyy")),
        F.try_to_timestamp(F.nullif(named, F.lit("")), F.lit("MMM d, yyyy")),
    )
    return F.when(F.coalesce(text, F.lit("")) == "", None).otherwise(
        F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), text)
    )


def clean_markdown(text: Column) -> Column:
    """Unix line ends, at most two empty lines in a row, no blanks at line ends."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(
        F.regexp_replace(F.regexp_replace(unix, "\n{4,}", "\n\n\n"), "[ \t]+\n", "\n"), r"^\s+|\s+$", ""
    )


def without_title(markdown: Column, title: Column) -> Column:
    """Body without a first heading that repeats the title."""
    line = F.regexp_extract(markdown, "^#[ \t]+([^\n]*)", 1)
    rest = F.regexp_replace(markdown, r"^#[^\n]*\n*", "")
    return F.when(F.lower(F.trim(line)) == F.lower(title), rest).otherwise(markdown)


def slug(title: Column, limit: int = 100) -> Column:
    """Lower-case ASCII letters and digits joined by dashes."""
    plain = F.translate(F.lower(title), "àáâãäåèéêëìíîïòóôõöùúûüýÿñç", "aaaaaaeeeeiiiiooooouuuuyync")
    dashed = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, limit), "-+$", "")
    return F.when(cut == "", "article").otherwise(cut)


def articles(parsed: DataFrame, site: str = "News") -> tuple[DataFrame, DataFrame]:
    """Finished articles with file name and front matter fields, and the rejected short bodies."""
    title = strip_suffix(F.col("raw_title"), site)
    table = (
        parsed.withColumns({"title": title, "date": normal_date(F.col("raw_date"))})
        .withColumn("body", without_title(clean_markdown(F.col("raw_markdown")), F.col("title")))
        .withColumn("article_id", article_id(canonical_url(F.col("url"))))
    )
    dated = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date")).otherwise("undated")
    done = table.where(F.length(F.trim("body")) >= MINIMUM_BODY).select(
        "page_id",
        "url",
        "article_id",
        "title",
        "date",
        "body",
        F.concat_ws("__", dated, slug(F.col("title")), F.concat(F.col("article_id"), F.lit(".md"))).alias("filename"),
    )
    rejected = table.where(F.length(F.trim("body")) < MINIMUM_BODY).select(
        "page_id", "url", "title", F.lit("short_or_empty_body").alias("error")
    )
    return done, rejected


def documents(done: DataFrame) -> DataFrame:
    """File name and full text with front matter of each article."""
    quote = lambda c: F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v")))
    field = lambda name, c: F.concat(F.lit(f"{name}: "), F.regexp_extract(quote(c), r'^\{"v":(.*)\}$', 1))
    text = F.concat_ws(
        "\n",
        F.lit("---"),
        field("title", F.col("title")),
        field("date", F.col("date")),
        field("url", F.col("url")),
        field("article_id", F.col("article_id")),
        F.lit("---"),
        F.lit(""),
        F.concat(F.lit("# "), F.col("title")),
        F.lit(""),
        F.col("body"),
    )
    return done.select("filename", "date", text.alias("text"))


def write_documents(finished: DataFrame, path: str) -> DataFrame:
    """Write finished documents in one folder a month (``undated`` for others) and read them back.

    Rows of a month are spread over tasks by file name; months that a call does not hold stay as they are.
    """
    month = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring("date", 1, 7)).otherwise("undated")
    rows = finished.select("filename", "text", month.alias("month"))
    write_table(rows, path, partition="month", files_by="filename")
    return finished.sparkSession.read.schema(rows.schema).parquet(path)
