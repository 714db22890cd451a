"""A search that asks its providers: fan-out, payloads, hits, pages, health.

All steps are plans over many queries; an engine's session runs them for one.
"""

from __future__ import annotations

import datetime
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import candidates, extraction, health
from quarry.options import AllProvidersFailed, EngineError, EngineOptions, PayloadError, SearchOptions
from quarry.plans.search import SearchResult, fan_out, search
from quarry.sources import payloads, serp
from quarry.sources.fetch import Resolver, Transport, fetched
from quarry.store import written

#: Health is worked out from so many last answers of all providers.
REMEMBERED = 2_000
#: Fixed value: the second page of this provider, asked along with the first.
FULL_PAGE = {"duckduckgo": "https://html.duckduckgo.com/html/?q="}
_EVENT = "event_id long, engine string, ts timestamp, success boolean, hard_block boolean, latency_ms double"


@dataclass(frozen=True)
class Gathered:
    hits: DataFrame
    providers: DataFrame


def _requests(asked: DataFrame, engine: EngineOptions, time_filter: str) -> DataFrame | None:
    out = None
    for name in engine.providers:
        if name == "searxng" and not engine.searxng_url:
            continue
        own = asked.where((F.col("engine") == name) & F.col("skip").isNull())
        page = "duckduckgo_lite" if name == "duckduckgo" else name
        pages = [(page, payloads.request(name, "query", time_filter, engine.searxng_url))]
        if name in FULL_PAGE:
            pages.append((name, F.concat(F.lit(FULL_PAGE[name]), F.url_encode("query"))))
        for kind, url in pages:
            rows = own.select("query_id", "query", "engine", F.lit(kind).alias("page"), url.alias("url"))
            out = rows if out is None else out.unionByName(rows)
    return out


def _hits_of(name: str, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, query_id and error of payloads that are none) of one provider."""
    of = lambda page: answers.where((F.col("page") == page) & F.col("error").isNull()).select("query_id", "query", F.col("body").alias("payload"))
    if name == "duckduckgo":
        return serp.duckduckgo(of("duckduckgo_lite"), of("duckduckgo")), serp.errors(of("duckduckgo_lite"), "duckduckgo_lite")
    if name in payloads.PARSERS:
        broken = payloads.parse_errors(of(name)) if name in payloads.JSON_PARSERS else of(name).limit(0)
        return payloads.PARSERS[name](of(name)), broken.select("query_id", F.lit("payload is no JSON").alias("error"))
    return serp.hits(of(name), name), serp.errors(of(name), name)


def gather(queries: DataFrame, engine: EngineOptions, get: Transport, resolve: Resolver, known: DataFrame | None = None, options: SearchOptions = SearchOptions()) -> Gathered:
    """What the providers of an engine answer to queries (query_id, query), up to deadline and quorum.

    An error of one provider, in its fetch or in its parser, is a row of
    ``providers`` and keeps no other from answering."""
    asked = written(fan_out(queries, engine, known), "asked")
    requests = _requests(asked, engine, options.time_filter)
    if requests is None:
        return Gathered(asked.limit(0).selectExpr("query_id", "query", "engine", "0 AS batch_ord", "0 AS pos", "'' AS title", "'' AS url", "'' AS snippet"), asked.selectExpr("query_id", "engine", "skip", "string(null) AS error", "0L AS hits", "0L AS latency_ms"))
    requests = written(requests, "requests")
    urls = requests.select("url").distinct().withColumn("fetch_ord", F.lit(0))
    got = fetched(urls, get, max(len(engine.providers), engine.fetch_concurrency), payloads_limit(), resolve).select("url", "body", "error", "total_fetch_ms")
    answers = written(requests.join(got, "url"), "answers")
    hits, errors = None, answers.select("query_id", "engine", "page", "error")
    for name in engine.providers:
        try:
            own, broken = _hits_of(name, answers.where(F.col("engine") == name))
            own = written(own.select("query_id", "pos", "title", "url", "snippet", "engine"), "hits")
            broken = written(broken.select("query_id", F.lit(name).alias("engine"), F.lit("").alias("page"), "error"), "broken")
        except (EngineError, PySparkException) as e:
            broken = asked.where((F.col("engine") == name) & F.col("skip").isNull()).select("query_id", "engine", F.lit("").alias("page"), F.lit(f"parser: {type(e).__name__}").alias("error"))
            own = None
        errors = errors.unionByName(broken)
        if own is not None:
            hits = own if hits is None else hits.unionByName(own)
    count = hits.groupBy("query_id", "engine").agg(F.count("*").alias("hits"), F.collect_list("url").alias("urls"))
    # A provider has failed if one of its pages is no page, or none was fetched.
    state = errors.groupBy("query_id", "engine").agg(F.max(F.when((F.col("page") == "") & F.col("error").isNotNull(), F.col("error"))).alias("bad"), F.min("error").alias("any"), F.count_if((F.col("page") != "") & F.col("error").isNull()).alias("fine"))
    took = answers.groupBy("query_id", "engine").agg(F.max("total_fetch_ms").alias("latency_ms"))
    rows = asked.join(state, ["query_id", "engine"], "left").join(count, ["query_id", "engine"], "left").join(took, ["query_id", "engine"], "left")
    n = F.coalesce("hits", F.lit(0))
    error = F.when(F.col("skip").isNull() & (n == 0), F.coalesce("bad", F.when(F.coalesce("fine", F.lit(0)) == 0, F.col("any"))))
    rows = written(rows.select("query_id", "query", "engine", "skip", error.alias("error"), n.cast("long").alias("hits"), F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"), F.coalesce("urls", F.array().cast("array<string>")).alias("urls")), "providers")
    policy = replace(engine.fanout, deadline_ms=options.fanout_deadline_ms) if options.fanout_deadline_ms else engine.fanout
    used = candidates.with_quorum(rows.where("skip IS NULL AND error IS NULL").select("query_id", "engine", "latency_ms", "urls"), policy).select("query_id", "engine", F.col("arrival").alias("batch_ord"))
    return Gathered(hits.join(used, ["query_id", "engine"]).join(queries.select("query_id", "query"), "query_id"), rows.drop("query", "urls"))


def payloads_limit() -> int:
    return 2 * 1024 * 1024


class LiveRun:
    """Runs one query against the providers, and remembers how they fared."""

    def __init__(self, spark: SparkSession, engine: EngineOptions, get: Transport, resolve: Resolver, embed: Callable[[list[str]], list[list[float]]] | None = None, clock: Callable[[], datetime.datetime] = datetime.datetime.now):
        self.spark, self.engine, self.get, self.resolve, self.embed, self.clock = spark, engine, get, resolve, embed, clock
        self.events: deque[tuple] = deque(maxlen=REMEMBERED)
        self.seen = 0

    def health(self) -> DataFrame | None:
        if not self.events:
            return None
        return health.snapshot(self.spark.createDataFrame(list(self.events), _EVENT), F.lit(self.clock()))

    def _remember(self, rows: list) -> None:
        for r in rows:
            if r["skip"] is None:
                hard = any(x in (r["error"] or "") for x in ("captcha", "challenge", "403", "429", "blocked"))
                self.events.append((self.seen, r["engine"], self.clock(), r["error"] is None, hard, float(r["latency_ms"])))
                self.seen += 1

    def fetch(self, wanted: DataFrame) -> DataFrame:
        return fetched(wanted, self.get, self.engine.fetch_concurrency, self.engine.max_response_bytes, self.resolve)

    def __call__(self, query: str, options: SearchOptions) -> SearchResult:
        """Raises AllProvidersFailed if providers were asked and none answered."""
        began = time.monotonic()
        queries = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        known = self.health()
        found = gather(queries, self.engine, self.get, self.resolve, written(known, "health") if known is not None else None, options)
        rows = found.providers.collect()  # one row a provider
        self._remember(rows)
        asked = [r for r in rows if r["skip"] is None]
        if asked and all(r["error"] is not None for r in asked):
            raise AllProvidersFailed(len(asked), [r.asDict() for r in rows])
        gathered = time.monotonic()
        result = search(queries, found.hits, self.fetch, options, self.engine, self.embed)
        ms = lambda a, b: int(1000 * (b - a))
        return replace(result, providers=found.providers, timings={"fan_out_ms": ms(began, gathered), "pages_ms": ms(gathered, time.monotonic()), "total_ms": ms(began, time.monotonic())})

    def fetch_page(self, url: str, options: SearchOptions = SearchOptions()) -> dict:
        """url, final_url, title, markdown, bytes_read and total_fetch_ms of one page."""
        table = self.spark.createDataFrame([(url, 0)], "url string, fetch_ord long")
        page = written(self.fetch(table), "page")
        got = page.first()
        if got["error"] is not None:
            raise PayloadError(got["error"])
        read = extraction.documents(page.select("url", F.col("body").alias("html")), options.max_page_chars).first()
        return {"url": url, "final_url": got["final_url"], "title": read["title"], "markdown": read["markdown"], "bytes_read": got["bytes_read"], "total_fetch_ms": got["total_fetch_ms"]}
