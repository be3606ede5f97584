"""Site-relative line frequency: lines on more than ``ratio`` of a host's pages are boilerplate.

The lines of a page are the visible text between block-level tags, trimmed,
without empty ones.  Each distinct line of a page counts once for its host,
by a 128-bit digest, so only (host, digest) pairs are shuffled, pre-aggregated
in the map tasks.  Per host, the digests above the ratio number at most
(lines per page) / ratio whatever the host's size, so they fit in one array
per host; pages join that array and filter their lines in place.  Both joins
on the host are salted ``FAN`` ways (the small side is repeated), as one host
may hold a third of all pages.

Cases: a null url has the empty host, which is a host like any other; null
html has no lines; a line of a
single page is never boilerplate, so hosts of one page drop nothing; repeated pages count each time; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import own

RATIO = 0.3
FAN = 16

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)"
HIDDEN = r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BLOCK = r"</?(?:p|br|div|li|ul|ol|nav|article|section|header|footer|aside|main|table|tr|h1|h2|h3|h4|h5|h6|title|head|body|html)(?:[ /][^>]*)?>"
TAG = r"<[^>]*>"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def lines_of(html: Column) -> Column:
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``(host, common)`` from ``pages(host, lines)``: the digests of lines on more than ``ratio`` of the host's pages."""
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    keys = pages.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.unhex(F.md5(x))))).alias("key"))
    counts = keys.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = counts.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(FAN)).cast("int"))
    often = counts.join(_fanned(totals), ["host", "salt"]).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("key").alias("common"))


def _fanned(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))))


def drop_lines(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
               ratio: float = RATIO) -> DataFrame:
    """Per page: ``page_id, host, n_lines, n_dropped, text`` (the lines that stay)."""
    p = own(pages, page_id, url, html).toDF("page_id", "url", "html").select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    salted = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "lines"), F.lit(FAN)).cast("int"))
    out = salted.join(_fanned(boilerplate(p, ratio)), ["host", "salt"], "left")
    none = F.array().cast("array<binary>")
    kept = F.filter("lines", lambda x: ~F.array_contains(F.coalesce("common", none), F.unhex(F.md5(x))))
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept")).select(
        "page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
