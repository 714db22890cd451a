"""Queries of extraction, result pages and the whole search, over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.expr import sql_string
from quarry.operators import extraction
from quarry.options import SearchOptions
from quarry.plans import search as s
from quarry.plans.q_pages import all_pages, hits
from quarry.plans.q_text import SAMPLE
from quarry.sources import serp

MARKDOWN = ["# Title\n\nsee [the docs](https://x.org) and [more](y)", "a\n```\ncode\n```\nb", "| a | b |\n|---|:-:|\n| 1 | 2 |", "**bold** and __under__ &lt;x&gt; &amp;amp;", "## # x\n  # y", "no marks"]
BING = "<ol>" + "".join(f'<li class="b_algo"><h2><a href="https://e.org/{i}">T <b>{i}</b></a></h2><div class="b_caption"><p>s{i}</p></div><cite>e.org</cite></li>' for i in range(3)) + '<li class="b_algo"><h2>no link</h2></li></ol>'


def markdown_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.documents(all_pages(spark, sf_dir)).select("page_id", "title", F.length("markdown").cast("long").alias("n_chars"), F.md5("markdown").alias("markdown_md5"))


def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.functions.pages import speakable

    return spark.createDataFrame([(i, m) for i, m in enumerate(MARKDOWN)], "id int, md string").select("id", speakable("md").alias("text"))


def parse_bing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serp.hits(spark.createDataFrame([(1, BING)], "query_id long, payload string"), "bing")


def search_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of seven questions over the pages as web."""
    queries = spark.createDataFrame([(i, SAMPLE[i]) for i in range(7)], "query_id long, query string")
    fetched = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", F.col("html").alias("body"), F.lit(None).cast("string").alias("error"))
    return s.search(queries, hits(spark, sf_dir), fetched, SearchOptions()).metrics


QUERIES = {"markdown_extract": markdown_extract, "sanitize": sanitize, "parse_bing": parse_bing, "search_end_to_end": search_end_to_end}
#: Fixed expectations: what the six samples read as.
_SPOKEN = ["Title\n\nsee the docs and more", "a\nb", "| a | b |\n| 1 | 2 |", "bold and under <x> &amp;", "x\ny", "no marks"]
_ROWS = ", ".join(f"({i}, {sql_string(x).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))})" for i, x in enumerate(_SPOKEN))
ORACLES = {
    "sanitize": f"SELECT * FROM (VALUES {_ROWS}) AS t(id, text)",
    "parse_bing": "SELECT 1::BIGINT AS query_id, i::INT AS pos, 'T ' || i AS title, 'https://e.org/' || i AS url, 'e.org' AS display_url, 's' || i AS snippet, 'bing' AS engine FROM range(3) AS t(i)",
}
