"""Listing pages and JSON answers that were already fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.functions.arrays import explode_with_place

# How many days back, how many records per listing page.
DAYS_BACK = 3
RECORDS_PER_PAGE = 10

_ANSWER = "query struct<pages: map<string, struct<extract: string>>>"


def day_urls(df: DataFrame, base: str, end: str, days: Column | int = DAYS_BACK) -> DataFrame:
    """``day, url`` of the listing page of each of the ``days`` days up to the date in ``end``."""
    count = F.lit(days) if isinstance(days, int) else days
    offsets = F.sequence(F.lit(0), (count - 1).cast("int"))
    return (
        df.select(F.col(end), F.explode_outer(offsets).alias("_back"))
        .select(F.date_sub(end, F.col("_back")).alias("day"))
        .withColumn("url", F.concat(F.lit(f"{base}/"), F.date_format("day", "yyyy/MM/dd"), F.lit("/")))
    )


def listing_links(
    pages: DataFrame, page_url: str, html: str, pattern: str, cap: int | None = RECORDS_PER_PAGE
) -> DataFrame:
    """``url, key`` and the place of the first ``cap`` links of each page, in page order; None takes all.

    The first group of ``pattern`` is the link; the key is its last path part without the last
    extension.
    """
    links = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    if cap is not None:
        links = F.slice(links, 1, cap)
    return (
        explode_with_place(pages, [page_url], links, "place", "_link")
        .withColumn("link_url", F.concat(page_url, "_link"))
        .withColumn("key", F.regexp_replace(F.substring_index("link_url", "/", -1), r"\.[^.]*$", ""))
        .drop("_link")
    )


def first_extract(answer: Column | str) -> Column:
    """The first non-empty ``extract`` among the pages of a JSON answer, else an empty text."""
    pages = F.map_values(F.from_json(answer, _ANSWER)["query"]["pages"])
    found = F.filter(F.transform(pages, lambda p: p["extract"]), lambda text: text != "")
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))
