"""Options of a search, their defaults and their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from quarry.functions.lexicon import DEFAULT_PROVIDERS, PROVIDERS


class EngineError(Exception):
    """Base of the errors that the engine raises."""


class InvalidConfiguration(EngineError):
    pass


class InvalidUrl(EngineError):
    pass


class SsrfBlocked(EngineError):
    pass


class TooManyRedirects(EngineError):
    pass


class PayloadError(EngineError):
    """A provider's payload cannot be parsed, or is a challenge."""


class AllProvidersFailed(EngineError):
    def __init__(self, attempted: int, metrics: list | None = None):
        super().__init__(f"all {attempted} providers failed")
        self.attempted, self.metrics = attempted, metrics or []


class EmbeddingError(EngineError):
    pass


@dataclass(frozen=True)
class FanoutPolicy:
    min_engines: int = 2
    min_domains: int = 3
    min_hits: int = 8
    deadline_ms: int = 1_200


@dataclass(frozen=True)
class RankingPolicy:
    two_stage: bool = True
    rerank_top: int = 10
    consensus_multiplier: float = 1.5
    min_score: float = 0.12
    coverage_floor: float = 0.5


@dataclass(frozen=True)
class SearchOptions:
    max_candidates: int = 3
    chunk_words: int = 150
    chunk_overlap: int = 30
    fetch_timeout_ms: int = 4_000
    max_response_bytes: int = 524_288
    fetch_slack: int = 2
    ranking_mode: str = "sparse"
    time_filter: str = "any"
    fanout_deadline_ms: int | None = None
    max_page_chars: int = 30_000

    def __post_init__(self) -> None:
        if self.ranking_mode not in ("sparse", "dense", "hybrid"):
            raise InvalidConfiguration(f"no such ranking mode: {self.ranking_mode}")
        if self.time_filter not in ("any", "day", "week", "month", "year"):
            raise InvalidConfiguration(f"no such time filter: {self.time_filter}")

    @property
    def pool(self) -> int:
        """Candidates to fetch: slack above the wanted ones, 8 at most unless more are wanted."""
        return min(self.max_candidates + self.fetch_slack, max(8, self.max_candidates))


@dataclass(frozen=True)
class EngineOptions:
    providers: list[str] = field(default_factory=lambda: list(DEFAULT_PROVIDERS))
    fanout: FanoutPolicy = FanoutPolicy()
    ranking: RankingPolicy = RankingPolicy()
    fetch_concurrency: int = 3
    fetch_timeout_ms: int = 4_000
    max_response_bytes: int = 512_000
    searxng_url: str | None = None

    def __post_init__(self) -> None:
        if not self.providers:
            raise InvalidConfiguration("an engine needs a provider")
        if unknown := set(self.providers) - set(PROVIDERS):
            raise InvalidConfiguration(f"no such providers: {sorted(unknown)}")
        if self.fetch_timeout_ms <= 0 or self.max_response_bytes <= 0:
            raise InvalidConfiguration("timeouts and sizes are above zero")
        object.__setattr__(self, "fetch_concurrency", max(1, self.fetch_concurrency))
        if self.searxng_url is not None and not self.searxng_url.strip():
            object.__setattr__(self, "searxng_url", None)
