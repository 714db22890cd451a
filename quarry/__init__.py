"""A Spark-native engine for retrieval analytics."""

from quarry.options import AllProvidersFailed, EngineError, EngineOptions, FanoutPolicy, InvalidConfiguration, RankingPolicy, SearchOptions
from quarry.plans.search import SearchResult, search
from quarry.plans.session import EngineBuilder, SearchEngine

__all__ = ["AllProvidersFailed", "EngineBuilder", "EngineError", "EngineOptions", "FanoutPolicy", "InvalidConfiguration", "RankingPolicy", "SearchEngine", "SearchOptions", "SearchResult", "search"]
__version__ = "0.1.0"
