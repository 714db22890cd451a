"""An engine with a bounded cache of results and one run for equal requests."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import Future
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import SparkSession

from quarry.functions import lexicon as lex
from quarry.options import EngineOptions, FanoutPolicy, InvalidConfiguration, RankingPolicy, SearchOptions
from quarry.plans.live import LiveRun
from quarry.sources.fetch import Resolver, Transport, plain_transport, system_resolver

CAPACITY, LEAST_WAIT_S, MOST_WAIT_S = 50, 0.05, 5.0


def cache_key(query: str, options: SearchOptions) -> str:
    parts = [query.strip().lower(), options.max_candidates, options.chunk_words, options.chunk_overlap, options.max_response_bytes, options.ranking_mode, options.time_filter]
    return ":".join(map(str, parts))


def result_ttl(query: str, time_filter: str = "any") -> int:
    words = set(query.lower().split())
    if time_filter in ("day", "week") or words & set(lex.NEWS_WORDS):
        return lex.NEWS_TTL
    return lex.DOCS_TTL if words & set(lex.DOCS_WORDS) else lex.OTHER_TTL


@dataclass
class _Kept:
    value: Any
    until: float


class ResultCache:
    """At most ``capacity`` results; full, it drops what is over, then what is over first."""

    def __init__(self, capacity: int = CAPACITY, clock: Callable[[], float] = time.monotonic):
        self.capacity, self.clock, self.kept, self.lock = capacity, clock, {}, threading.Lock()

    def get(self, key: str) -> Any | None:
        with self.lock:
            found = self.kept.get(key)
            return found.value if found and self.clock() < found.until else None

    def put(self, key: str, value: Any, ttl: float) -> None:
        with self.lock:
            now = self.clock()
            if len(self.kept) >= self.capacity:
                self.kept = {k: v for k, v in self.kept.items() if now < v.until}
                if len(self.kept) >= self.capacity:
                    del self.kept[min(self.kept, key=lambda k: self.kept[k].until)]
            self.kept[key] = _Kept(value, now + ttl)


class Coalescer:
    """Equal requests at one time run once; those that wait too long, or whose
    leader fails, run by themselves."""

    def __init__(self) -> None:
        self.flights: dict[str, Future] = {}
        self.lock = threading.Lock()

    def run(self, key: str, work: Callable[[], Any], wait_s: float) -> Any:
        with self.lock:
            flight = self.flights.get(key)
            if leads := flight is None:
                flight = self.flights[key] = Future()
        if not leads:
            try:
                return flight.result(min(max(wait_s, LEAST_WAIT_S), MOST_WAIT_S))
            except (FutureTimeout, Exception):  # noqa: B014
                return work()
        try:
            value = work()
            flight.set_result(value)
            return value
        except BaseException as e:
            flight.set_exception(e)
            raise
        finally:
            with self.lock:
                self.flights.pop(key, None)


class SearchEngine:
    """``run(query, options)`` makes a result; blank queries give ``empty()``."""

    def __init__(self, spark: SparkSession, run: Callable[[str, SearchOptions], Any], options: EngineOptions = EngineOptions(), empty: Callable[[], Any] = lambda: None):
        self.spark, self.options, self._run, self._empty = spark, options, run, empty
        self.cache, self.coalescer = ResultCache(), Coalescer()

    def fetch_page(self, url: str, options: SearchOptions = SearchOptions()) -> dict:
        """One page, read as a search reads it."""
        if not hasattr(self._run, "fetch_page"):
            raise InvalidConfiguration("this engine's source fetches no single pages")
        return self._run.fetch_page(url, options)

    @property
    def providers(self) -> list[str]:
        return list(self.options.providers)

    def search(self, query: str, options: SearchOptions = SearchOptions()) -> Any:
        if not query.strip():
            return self._empty()
        key = cache_key(query, options)
        if (found := self.cache.get(key)) is not None:
            return found

        def work() -> Any:
            value = self._run(query.strip(), options)
            self.cache.put(key, value, result_ttl(query, options.time_filter))
            return value

        return self.coalescer.run(key, work, options.fetch_timeout_ms / 1000)


class EngineBuilder:
    def __init__(self, spark: SparkSession):
        self.spark, self.settings = spark, {}
        self._run: Callable[[str, SearchOptions], Any] | None = None
        self.embedder: Callable[[list[str]], list[list[float]]] | None = None
        self.transport: Transport | None = None
        self.resolver: Resolver = system_resolver

    def _with(self, **settings: Any) -> EngineBuilder:
        self.settings |= settings
        return self

    def with_providers(self, providers: list[str]) -> EngineBuilder:
        return self._with(providers=list(providers))

    def with_fanout_policy(self, policy: FanoutPolicy) -> EngineBuilder:
        return self._with(fanout=policy)

    def with_ranking_policy(self, policy: RankingPolicy) -> EngineBuilder:
        return self._with(ranking=policy)

    def with_embedder(self, embed: Callable[[list[str]], list[list[float]]]) -> EngineBuilder:
        self.embedder = embed
        return self

    def with_fetch_concurrency(self, n: int) -> EngineBuilder:
        return self._with(fetch_concurrency=n)

    def with_fetch_timeout(self, ms: int) -> EngineBuilder:
        return self._with(fetch_timeout_ms=ms)

    def with_max_response_bytes(self, n: int) -> EngineBuilder:
        return self._with(max_response_bytes=n)

    def with_searxng_url(self, url: str | None) -> EngineBuilder:
        return self._with(searxng_url=url)

    def with_transport(self, get: Transport, resolve: Resolver = system_resolver) -> EngineBuilder:
        """How addresses are asked and names resolved; both run on executors."""
        self.transport, self.resolver = get, resolve
        return self

    def with_source(self, run: Callable[[str, SearchOptions], Any]) -> EngineBuilder:
        """What works out the result of one query that is not in the cache."""
        self._run = run
        return self

    def build(self) -> SearchEngine:
        options = replace(EngineOptions(), **self.settings)
        get = self.transport or plain_transport(options.fetch_timeout_ms, options.max_response_bytes)
        return SearchEngine(self.spark, self._run or LiveRun(self.spark, options, get, self.resolver, self.embedder), options)
