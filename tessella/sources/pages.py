"""Pages: HTML to text and links, feeds, and a pluggable paged source."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_BLOCK = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table"}
_SKIP = {"script", "style", "noscript", "template"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.links: list[str] = []
        self.title = ""
        self.skip = 0
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in _SKIP
        self.in_title = tag == "title"
        if tag in _BLOCK:
            self.parts.append("\n")
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)

    def handle_endtag(self, tag: str) -> None:
        self.skip = max(0, self.skip - (tag in _SKIP))
        self.in_title = False
        if tag in _BLOCK:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.parts.append(data)


def read_html(html: str, base: str | None = None) -> tuple[str, str, list[str]]:
    """(title, text, links) of a page; broken markup gives what can be read."""
    r = _Reader()
    r.feed(html)
    r.close()
    lines = (re.sub(r"[ \t\xa0]+", " ", x).strip() for x in "".join(r.parts).split("\n"))
    links = [urljoin(base, x) if base else x for x in r.links]
    return r.title.strip(), "\n".join(x for x in lines if x), [*dict.fromkeys(x.split("#")[0] for x in links if x.split("#")[0])]


def html_text(rows: DataFrame, key: str, html: str, url: str | None = None) -> DataFrame:
    """(key, title, text, links) of each page; null pages give nulls."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases = batch.column(2).to_pylist() if url else [None] * batch.num_rows
            out = [(None, None, None) if h is None else read_html(h, b) for h, b in zip(batch.column(1).to_pylist(), bases)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], k) for i, k in ((0, pa.string()), (1, pa.string()), (2, pa.list_(pa.string()))))], names=[key, "title", "text", "links"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, html, *([url] if url else [])).mapInArrow(run, f"`{key}` {kind}, title string, text string, links array<string>")


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, published) of the items of RSS files and the entries of Atom files; namespaces do not matter."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.regexp_replace("value", r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"<(/?)\w+:(\w)", "<$1$2").alias("x"))
    item = F.explode(F.regexp_extract_all("x", F.lit(r"(?s)(<(?:item|entry)[ >].*?</(?:item|entry)>)"), F.lit(1))).alias("i")
    tag = lambda t: F.trim(F.regexp_replace(F.regexp_extract("i", rf"(?s)<{t}[^>]*>(.*?)</{t}>", 1), r"<!\[CDATA\[|\]\]>", ""))
    link = F.coalesce(F.nullif(tag("link"), F.lit("")), F.nullif(F.regexp_extract("i", r'<link[^>]*href="([^"]+)"', 1), F.lit("")))
    date = F.coalesce(*[F.nullif(tag(t), F.lit("")) for t in ("pubDate", "published", "updated", "date")])
    return text.select(item).select(tag("title").alias("title"), link.alias("link"), date.alias("published"))


def json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines of one file, folder or a comma list; broken lines are kept in `_broken` and do not end the read."""
    files = paths.split(",") if isinstance(paths, str) else paths
    return spark.read.schema(schema + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json([f.strip() for f in files])


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedSource(DataSource):
    """A source of numbered pages: `fetch(page) -> list of (id, title, body)` is given by name (module:function) in the
    option `fetch`, the number of pages in `pages`. Each page is a partition, read by an executor."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, id string, title string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch, self.pages = options["fetch"], int(options.get("pages", "1"))

    def partitions(self) -> list[InputPartition]:
        return [_Page(i) for i in range(self.pages)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        from importlib import import_module

        module, _, name = self.fetch.partition(":")
        fetch: Callable = getattr(import_module(module), name)
        for x in fetch(partition.number):
            yield (partition.number, *x)
