"""From fetched pages to readable ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions import dom
from quarry.functions import pages as p
from quarry.functions.expr import trim_ws
from quarry.options import SearchOptions
from quarry.store import written

MAX_CHARS = 30_000


@F.pandas_udf(StringType())
def _markdown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for html in batches:
        yield html.map(lambda x: dom.markdown(x or ""))


@F.pandas_udf(StringType())
def _dom_title(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for html in batches:
        yield html.map(lambda x: dom.dom_title(x or ""))


def documents(pages: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """``pages`` (url, html) with title (the URL if there is none) and markdown.

    Only pages whose title the scan cannot find are parsed for it."""
    scanned = pages.withColumn("title", p.page_title("html"))
    found = scanned.where("title IS NOT NULL").unionByName(scanned.where("title IS NULL").withColumn("title", _dom_title("html")))
    text = F.left(p.speakable(_markdown("html")), F.lit(max_chars))
    return found.withColumns({"title": F.coalesce("title", "url"), "markdown": F.coalesce(text, F.lit(""))})


def gated(pages: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Of ``pages`` (query_id, query, fetch_ord, url, html) the readable ones,
    ``max_candidates`` a query at most, with page_ord from 0.

    Empty pages, challenges and code go; pages in another script wait, and the
    first of them is let in only if no other page of its query is left."""
    fetched = pages.where(trim_ws(F.coalesce("html", F.lit(""))) != "")
    # Written, as each gate would work out the text again.
    read = written(documents(fetched, options.max_page_chars), "read")
    read = read.where(~p.is_challenge("title", "markdown")).where(~p.is_code_like("markdown"))
    read = read.withColumn("_waits", p.other_script("url", "query"))
    own = Window.partitionBy("query_id")
    first = F.row_number().over(Window.partitionBy("query_id", "_waits").orderBy("fetch_ord"))
    read = read.withColumn("_r", first).withColumn("_any", F.max((~F.col("_waits")).cast("int")).over(own))
    read = read.where((~F.col("_waits")) | ((F.col("_any") == 0) & (F.col("_r") == 1)))
    read = read.withColumn("page_ord", F.row_number().over(own.orderBy("fetch_ord")) - 1)
    return read.where(F.col("page_ord") < options.max_candidates).drop("_waits", "_r", "_any")
