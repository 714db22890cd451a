"""The whole search as one lazy plan over many queries.

``queries`` has query_id and query; ``hits`` the providers' result lists (see
quarry.operators.candidates); ``fetched`` what addresses answered (url, body,
content_type, error), or a function that fetches a table of url and fetch_ord.  What several later steps need is written once, to the
shared folder: queries, hits, wanted pages as they answered and as they are read, ranked passages and what is delivered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import understand as u
from quarry.operators import candidates, chunking, extraction, ranking, verification
from quarry.options import EngineOptions, SearchOptions
from quarry.store import written


@dataclass(frozen=True)
class SearchResult:
    pages: DataFrame
    passages: DataFrame
    metrics: DataFrame
    #: query_id, engine, skip, error, hits, latency_ms of every provider, if the engine asked them.
    providers: DataFrame | None = None
    #: Milliseconds of the engine's steps.
    timings: dict[str, int] = field(default_factory=dict)


def search(
    queries: DataFrame, hits: DataFrame, fetched: DataFrame | Callable[[DataFrame], DataFrame], options: SearchOptions = SearchOptions(), engine: EngineOptions = EngineOptions(), embed: Callable[[list[str]], list[list[float]]] | None = None
) -> SearchResult:
    asked = queries.select("query_id", F.trim("query").alias("query")).where("query <> ''")
    # Written, its size is known: a few queries are broadcast, and their hits stay spread.
    understood = written(candidates.understood(asked), "asked")
    asked = understood.select("query_id", "query")
    own = hits.join(asked, "query_id", "left_semi")
    own = written(own, "hits")
    listed = written(candidates.firsts(own), "listed")
    agreed = candidates.consensus(own)
    wanted = written(candidates.ordered(listed.drop("query").join(understood, "query_id"), options.pool), "wanted")
    if callable(fetched):
        fetched = written(fetched(wanted.groupBy("url").agg(F.min("fetch_ord").alias("fetch_ord"))), "fetched")
    answers = fetched.where("error IS NULL").select("url", F.col("body").alias("html"))
    # Written as they are: what asks for a title or a text would be worked out for all that was fetched, as filters move below a join.
    answered = written(wanted.select("query_id", "query", "fetch_ord", "url").join(answers, "url"), "answered")
    pages = written(extraction.gated(answered, options), "pages")
    cut = written(chunking.passages(pages.select("query_id", "query", "page_ord", F.col("url").alias("source_url"), F.col("title").alias("source_title"), "markdown"), options.chunk_words, options.chunk_overlap), "passages")
    generated = cut.groupBy("query_id").agg(F.count("*").alias("generated"))
    best = written(ranking.ranked(cut, options.ranking_mode, embed, agreed, engine.ranking), "ranked")
    passages, single = verification.drained(asked, best, pages, engine.ranking.coverage_floor)
    passages = written(passages, "delivered")
    verdicts = verification.answer_presence(asked, passages)
    failures = verification.failure_class(asked, passages, pages, verdicts, single, generated, listed)
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    metrics = asked
    for part in (count(own, "total_raw_hits"), count(listed, "deduplicated_hits"), count(wanted, "candidates"), count(pages, "pages"), generated.withColumnRenamed("generated", "total_passages_generated"), count(passages, "passages")):
        metrics = metrics.join(part, "query_id", "left")
    numbers = ["total_raw_hits", "deduplicated_hits", "candidates", "pages", "total_passages_generated", "passages"]
    metrics = metrics.fillna(0, numbers).join(verdicts, "query_id").join(failures, "query_id")
    presence = F.when(F.col("presence") != "not_applicable", F.col("presence"))
    metrics = metrics.select("query_id", *numbers, F.col("shape").alias("answer_shape"), presence.alias("answer_presence"), "failure_class", F.lit(options.ranking_mode).alias("ranking_mode"))
    return SearchResult(pages.select("query_id", "page_ord", "url", "title", "markdown"), passages, metrics)


def fan_out(queries: DataFrame, engine: EngineOptions, health: DataFrame | None = None) -> DataFrame:
    """query_id, query, engine, skip for every provider of the engine."""
    names = F.array(*map(F.lit, engine.providers))
    return candidates.skip_plan(queries.select("query_id", "query", F.explode(names).alias("engine")), health, engine.searxng_url)


def ttl(query: Column | str, options: SearchOptions = SearchOptions()) -> Column:
    return u.result_ttl(query, options.time_filter)
