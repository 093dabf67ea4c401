"""Scrapes over tables of fetched pages (page_id, url, html)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import markup

LINK = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def plain(html: Column) -> Column:
    """The text of a fragment, without tags."""
    return F.trim(F.regexp_replace(html, r"<[^>]*>", ""))


def absolute(base: Column, href: Column) -> Column:
    """A link resolved against its page's address."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^?#]*/)", 1)
    folder = F.when(F.length(folder) > F.length(origin), folder).otherwise(F.concat(origin, F.lit("/")))
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#") | (href == ""), F.concat(F.regexp_extract(base, "^([^#]*)", 1), href))
        .otherwise(F.concat(folder, href))
    )


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, text, target) of the links of each page."""
    hrefs, texts = F.regexp_extract_all("html", F.lit(LINK), 1), F.regexp_extract_all("html", F.lit(LINK), 2)
    rows = pages.select("page_id", "url", F.posexplode(F.arrays_zip(hrefs.alias("href"), texts.alias("text"))).alias("pos", "x"))
    return rows.select("page_id", "pos", F.col("x.href").alias("href"), plain(F.col("x.text")).alias("text"), absolute(F.col("url"), F.col("x.href")).alias("target"))


def table_rows(pages: DataFrame, needed: str | None = None, max_entries: int = -1) -> DataFrame:
    """(page_id, row_no, cells): cells by header, each with its text and first link. Of each page the first ``max_entries`` rows (-1: all), less those that lack the link of the column ``needed``.

    A table's headers are its first row with a header cell; rows of nothing
    else but header cells are not counted. Of columns that share a header the
    first one counts. A table without headers has none. See ``markup`` for
    spans, nested tables and tags that are missing.
    """
    rows = pages.select("page_id", "url", F.explode(F.filter(markup.table_grids(F.col("html")), lambda r: F.size(r["cells"]) > 0)).alias("r")).select("page_id", "url", "r.*")
    by = Window.partitionBy("page_id", "table_no").orderBy("row_no")  # a page's table
    titles = F.when(F.exists("cells", lambda c: c["head"]), F.transform("cells", lambda c: c["text"]))
    rows = rows.withColumn("heads", F.first(titles, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.where(F.col("heads").isNotNull() & F.exists("cells", lambda c: ~c["head"]))
    rows = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("page_id").orderBy("table_no", "row_no")) - 1)
    cell = lambda c: F.struct(c["text"].alias("text"), F.when(c["href"].isNotNull(), absolute(F.col("url"), c["href"])).alias("link"))
    pairs = F.filter(F.transform("cells", lambda c, i: F.struct(F.get("heads", i).alias("k"), cell(c).alias("v"), i.alias("i"))), lambda x: x["k"].isNotNull() & (F.array_position("heads", x["k"]) == x["i"] + 1))
    out = rows.select("page_id", "row_no", F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["k"], x["v"]))).alias("cells"))
    out = out.where(F.col("row_no") < max_entries) if max_entries >= 0 else out
    return out.where(F.col("cells")[needed]["link"].isNotNull()) if needed else out


def paragraph_terms(pages: DataFrame) -> DataFrame:
    """Distinct terms: the first token of each paragraph up to a space or bracket, and the text of its first link."""
    p = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1)).alias("p"))
    first = F.regexp_extract(plain(F.col("p")), r"^([^\s(]+)", 1)
    return p.select(F.explode(F.array(first, plain(F.regexp_extract("p", LINK, 2)))).alias("gloss")).where(F.col("gloss") != "").distinct()
