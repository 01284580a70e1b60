"""Line deduplication by site-relative frequency, in DataFrame functions.

Of a host's pages, the share that contain a line tells boilerplate from content.
Counts per (host, line) combine map-side, so a host with a third of all pages and
a line on each of them cost a row per task. Lines above the ratio are few: over
all lines of a host the page counts sum to its lines, so at most
(lines per page) / ratio of them pass; they travel as one list per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.llm.common import lookup_join, materialise, packed, quoted

RATIO = 0.3
MIN_PAGES = 5
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
_BLOCK = r"(?i)</?(?:p|br|hr|li|ul|ol|dl|dt|dd|nav|div|h[1-6]|title|head|header|footer|main|body|html|article|aside|section|table|tr|td|th|form|option|blockquote|pre)\b[^>]*>"
_TAG = r"<[^>]*>"


def host(url: Column) -> Column:
    """Lower-case host of a URL; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def html_text(html: Column) -> Column:
    """A page's text: scripts, styles, comments and tags removed, a line per block element."""
    shown = F.regexp_replace(F.regexp_replace(html, _HIDDEN, ""), _BLOCK, "\n")
    return F.regexp_replace(shown, _TAG, "")


def lines_of(text: Column) -> Column:
    """The lines of a text, without white space at their ends, blank ones left out; null: none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x, F.lit(" \t\r\v\f")))
    return F.filter(lines, lambda x: x != F.lit(""))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host -> list of its lines on more than `ratio` of its pages, from rows (host, lines). Hosts of fewer pages have none."""
    known = pages.filter("host is not null")
    totals = materialise(known.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages), "line-hosts")
    seen = known.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    common = lookup_join(seen, totals, ["host"], F.xxhash64("line")).filter(F.col("n") > ratio * F.col("pages"))
    return common.groupBy("host").agg(F.collect_set("line").alias("common"))


def clean(pages: DataFrame, text: Column, url_col: str = "url", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Rows (row, host, n_lines, n_dropped, cleaned): all columns of `pages`, and the text without the host's boilerplate.

    `text` is an expression over `pages`; null or empty text has no lines. Pages
    without a host are compared with none and keep all lines; so do those of
    hosts with fewer than `min_pages` pages. A line that repeats on a page counts
    once there and goes everywhere. Repeated rows are pages of their own. An empty
    table gives no rows.
    """
    slim = pages.select(host(quoted(url_col)).alias("host"), lines_of(text).alias("lines"))
    drop = materialise(boilerplate(slim, ratio, min_pages), "line-boilerplate")
    rows = pages.select(packed(pages).alias("row"), host(quoted(url_col)).alias("host"), lines_of(text).alias("lines"))
    rows = lookup_join(rows, drop, ["host"], F.xxhash64("lines"))
    kept = F.when(F.col("common").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("common"), x)))
    rows = rows.withColumn("kept", kept)
    n, left = F.size("lines").cast("long"), F.size("kept").cast("long")
    return rows.select("row", "host", n.alias("n_lines"), (n - left).alias("n_dropped"), F.array_join("kept", "\n").alias("cleaned"))
