"""News feeds: RSS files and HTML pages to articles, merged, deduplicated, capped.

Fetching is a plug-in: what it stores (files) is what these sources read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.text import strip_html
from trellis.operators.ties import keep_first

@dataclass(frozen=True)
class Site:
    """How a site shows its articles: the elements that hold one (with a pattern of their class), the
    elements to look for where there are none of these, the headings that are titles, and the site's address."""

    name: str
    address: str
    tags: str = "article|div"
    of_class: str | None = "news|article|post"
    otherwise: tuple[str, str] | None = None
    headings: str = "h2|h3|h4"


def site_articles(pages: DataFrame, site: Site, html: str = "html", most: int | None = None) -> DataFrame:
    """pages with the articles of one site: position, source, title, link (absolute), summary (400 characters).
    An element reaches to the next one; what has no title is left out; ``most`` elements of a page count."""
    def blocks(tags: str, of_class: str | None) -> Column:
        opening = rf"<(?:{tags})\b" + (rf'(?=[^>]*\bclass="[^"]*(?:{of_class}))' if of_class else "")
        return F.filter(F.split(html, f"(?is)(?={opening})"), lambda b: b.rlike(f"(?is)^{opening}"))

    found = blocks(site.tags, site.of_class)
    if site.otherwise:
        found = F.when(F.size(found) > 0, found).otherwise(blocks(*site.otherwise))
    items = pages.select("*", F.posexplode(found if most is None else F.slice(found, 1, most)).alias("position", "__b"))
    inner = lambda pattern, limit: F.substring(F.trim(F.regexp_replace(F.regexp_extract("__b", pattern, 1), r"<[^>]+>", "")), 1, limit)
    href = F.regexp_extract("__b", r'(?is)<a\b[^>]*\bhref="([^"]*)"', 1)
    link = F.when(href == "", "").when(href.startswith("http"), href).otherwise(F.concat(F.lit(site.address), href))
    out = items.withColumns({"source": F.lit(site.name), "title": inner(rf"(?is)<(?:{site.headings})\b[^>]*>(.*?)</(?:{site.headings})>", 1000), "link": link, "summary": inner(r"(?is)<p\b[^>]*>(.*?)</p>", 400)})
    return out.where("title <> ''").drop("__b")


ARTICLE = "source string, title string, link string, published string, summary string"


def _articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xml.etree.ElementTree as ET

    fields = ("title", "link", "pubDate", "description")
    for batch in batches:
        rows: list[tuple] = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                root = ET.fromstring(content)
            except ET.ParseError:
                rows.append((path, None, None, None, None))  # reported by ``broken``
                continue
            rows += [(path, *(item.findtext(f) for f in fields)) for item in root.iter("item")]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["source", "title", "link", "published", "summary"])


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Articles of RSS files; source is the file. A file that is no XML gives one row with a null title."""
    return articles_of(spark.read.format("binaryFile").load(path))


def articles_of(files: DataFrame) -> DataFrame:
    """Articles of (path, content) rows."""
    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(_articles, ARTICLE)


def broken(articles: DataFrame) -> DataFrame:
    return articles.where("title is null").select("source").distinct()


def timed(articles: DataFrame) -> DataFrame:
    """With ``date`` from the published text (null if it is none) and tags stripped from the summary."""
    zone = F.regexp_replace(F.regexp_replace("published", r"^\w{3},\s*", ""), r"GMT|UTC", "+0000")
    return articles.withColumn("date", F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z"))).withColumn("summary", strip_html(F.col("summary")))


def links_in(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with each link of the HTML: position, href, title (tags stripped)."""
    anchors = F.regexp_extract_all(html, F.lit(r'(?is)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    exploded = pages.select("*", F.posexplode(anchors).alias("position", "__a"))
    return exploded.withColumn("href", F.regexp_extract("__a", r'(?i)href="([^"]*)"', 1)).withColumn("title", strip_html(F.col("__a"), 200)).drop("__a")


def cap_per_source(articles: DataFrame, n: int, order: list[Column]) -> DataFrame:
    from pyspark.sql import Window

    return articles.withColumn("__rank", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def merged(articles: DataFrame, sequence: str, cap: int | None = None) -> DataFrame:
    """The latest first; of equal titles (lower-cased, 100 characters) the first stays. The
    ingestion sequence breaks ties, so the order is total."""
    latest_first = [F.col("date").desc_nulls_last(), F.col(sequence)]
    once = keep_first(articles, [F.substring(F.lower("title"), 1, 100)], latest_first)
    return once if cap is None else once.orderBy(*latest_first).limit(cap)


def recent(articles: DataFrame, now: Column, days: int = 14, fallback: int = 10, sequence: str = "seq") -> DataFrame:
    """Articles of the last days, or else the first ``fallback``."""
    from trellis.operators.shapes import with_fallback

    fresh = articles.where(F.col("date") > now - F.expr(f"INTERVAL {days} DAYS"))
    return with_fallback(fresh, articles.orderBy(F.col("date").desc_nulls_last(), sequence).limit(fallback))


def digest_text(articles: DataFrame, most: int = 12, sequence: str = "seq") -> DataFrame:
    """One row: the first ``most`` articles, latest first, as the text that a summary is made of."""
    first = articles.orderBy(F.col("date").desc_nulls_last(), sequence).limit(most)
    entry = F.struct(F.col("date").isNull(), -F.unix_timestamp("date"), F.col(sequence), F.concat_ws(": ", "source", "title").alias("line"))
    return first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["line"]), "\n").alias("text"))
