"""Line dedup by site-relative frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialens.llm.common import column, small, whole_row, written

#: A line is boilerplate if over this share of its site's pages contain it, and at least so many pages.
RATIO, LEAST_PAGES = 0.05, 2
_SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """What makes two lines equal: their characters without white space at the ends."""
    return F.xxhash64(F.btrim(line, F.lit(_SPACES)))


def boilerplate(docs: DataFrame, site: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``site, line, pages, share`` of each line that over ``ratio`` of the site's pages contain, and ``least_pages`` at least."""
    pages = docs.select(column(site).alias("site"), F.coalesce("text", F.lit("")).alias("text"))
    totals = pages.groupBy("site").agg(F.count("*").alias("total"))
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), line_key))
    counts = pages.select("site", F.explode(keys).alias("line")).groupBy("site", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    out = counts.join(totals, counts["site"].eqNullSafe(totals["site"])).select(counts["site"], "line", "pages", (F.col("pages") / F.col("total")).alias("share"))
    return out.where(F.col("share") > ratio)


def drop_boilerplate(docs: DataFrame, site: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; all other columns and all rows stay.

    Sites are grouped by ``site`` (null is a site of its own); a page counts once for a line however often it holds it.
    Lines are parted by \\n and compared without white space at their ends; lines without a word are kept and never counted.
    The kept lines stand as they were, in their order. A null text stays null; repeated rows count as pages each; a site with
    fewer than ``least_pages`` pages loses nothing; an empty table stays empty.
    """
    found = written(boilerplate(docs, site, ratio, least_pages), "lines")
    sites = found.groupBy("site").agg(F.collect_set("line").alias("drop"))  # under 1 / ratio times a site's mean lines a page
    sites = small(written(sites, "sites"), 2_000)
    # the columns of docs go along in a struct, so that none of their names clashes
    rows = docs.select(whole_row(docs.columns).alias("row"), column(site).alias("own"), F.col("text").alias("text"))
    joined = rows.join(sites, F.col("own").eqNullSafe(F.col("site")), "left")
    kept = F.filter(F.split("text", "\n"), lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains("drop", line_key(x))))
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*(text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def by_host(pages: DataFrame, url: str = "url", other: str | None = None, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``drop_boilerplate`` with the host of each row's url as its site; rows without one count under ``other``, if given."""
    names = pages.columns
    host = F.lower(F.try_parse_url(column(url), F.lit("HOST")))
    site = host if other is None else F.coalesce(host, column(other).cast("string"))
    rows = pages.select(whole_row(names).alias("row"), F.col("text").alias("text"), site.alias("host"))
    out = drop_boilerplate(rows, "host", ratio, least_pages)
    return out.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in names))
