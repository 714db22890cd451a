"""Hits out of JSON and feed payloads, without Python.

A payload table has query_id, query and payload (text).  Each parser gives
query_id, pos (place among the payload's items, from 0), title, url,
display_url, snippet and engine; items that lack what a hit needs are left out.
A payload that is no JSON gives no hits (``parse_errors`` lists those rows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import lexicon as lex
from quarry.functions.expr import trim_ws, words
from quarry.functions.pages import strip_tags
from quarry.functions.understand import has_any_phrase


def _text(c: Column | str) -> Column:
    return trim_ws(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _is_http(url: Column) -> Column:
    return F.startswith(url, F.lit("http"))


def _items(payloads: DataFrame, schema: str, field: str) -> DataFrame:
    parsed = F.from_json("payload", schema, {"mode": "PERMISSIVE"})
    return payloads.select("query_id", F.posexplode(parsed[field]).alias("pos", "i")).where("i IS NOT NULL")


def _hits(items: DataFrame, engine: str, title: Column, url: Column, display: Column | str, snippet: Column, keep: Column) -> DataFrame:
    shown = F.lit(display) if isinstance(display, str) else display
    made = items.select("query_id", "pos", _text(title).alias("title"), _text(url).alias("url"), _text(shown).alias("display_url"), _text(snippet).alias("snippet"), F.lit(engine).alias("engine"), keep.alias("_keep"))
    return made.where("_keep").drop("_keep")


def searxng(payloads: DataFrame) -> DataFrame:
    i = _items(payloads, "results array<struct<url:string,title:string,content:string>>", "results")
    url, title = _text("i.url"), _text("i.title")
    return _hits(i, "searxng", title, url, "", _text("i.content"), _is_http(url) & (title != ""))


def wikipedia(payloads: DataFrame) -> DataFrame:
    i = _items(payloads, "pages array<struct<key:string,title:string,excerpt:string,description:string>>", "pages")
    key = F.coalesce("i.key", F.lit(""))
    title = F.when(_text("i.title") == "", F.replace(key, F.lit("_"), F.lit(" "))).otherwise(F.col("i.title"))
    excerpt = strip_tags("i.excerpt")
    snippet = F.when(_text(excerpt) != "", excerpt).otherwise(F.col("i.description"))
    return _hits(i, "wikipedia", title, F.concat(F.lit("https://en.wikipedia.org/wiki/"), key), F.concat(F.lit("en.wikipedia.org/wiki/"), key), snippet, _text(key) != "")


def scholar(payloads: DataFrame) -> DataFrame:
    i = _items(payloads, "data array<struct<title:string,url:string,abstract:string,year:bigint>>", "data")
    url, title = _text("i.url"), _text("i.title")
    year = F.coalesce(F.col("i.year").cast("string"), F.lit(""))
    snippet = F.concat(F.left(F.coalesce("i.abstract", F.lit("")), F.lit(220)), F.lit(" ("), year, F.lit(")"))
    return _hits(i, "scholar", title, url, "semanticscholar.org", snippet, _is_http(url) & (title != ""))


def stackexchange(payloads: DataFrame) -> DataFrame:
    i = _items(payloads, "items array<struct<title:string,link:string,score:bigint,answer_count:bigint,is_answered:boolean>>", "items")
    url, title = _text("i.link"), _text("i.title")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    accepted = F.when(F.coalesce("i.is_answered", F.lit(False)), F.lit(", accepted answer")).otherwise(F.lit(""))
    snippet = F.concat(F.lit("Stack Overflow: score "), number("i.score"), F.lit(", "), number("i.answer_count"), F.lit(" answers"), accepted)
    return _hits(i, "stackexchange", title, url, "stackoverflow.com", snippet, _is_http(url) & (title != ""))


def mdn(payloads: DataFrame) -> DataFrame:
    i = _items(payloads, "documents array<struct<title:string,mdn_url:string,summary:string>>", "documents")
    path, title = _text("i.mdn_url"), _text("i.title")
    return _hits(i, "mdn", title, F.concat(F.lit("https://developer.mozilla.org"), path), "developer.mozilla.org", _text("i.summary"), (path != "") & (title != ""))


def github_endpoint(query: Column | str) -> Column:
    return F.when(has_any_phrase(query, lex.ISSUE_WORDS), F.lit("issues")).otherwise(F.lit("repositories"))


def github(payloads: DataFrame) -> DataFrame:
    """Items with a number of stars are repositories, others issues."""
    i = _items(payloads, "items array<struct<html_url:string,stargazers_count:bigint,description:string,full_name:string,repository_url:string,title:string,state:string>>", "items")
    url, text = _text("i.html_url"), lambda c: F.coalesce(c, F.lit(""))
    repo = F.col("i.stargazers_count").isNotNull()
    home = F.replace(text("i.repository_url"), F.lit("https://api.github.com/repos/"), F.lit(""))
    title = F.when(repo, text("i.full_name")).otherwise(F.concat(home, F.lit(": "), text("i.title")))
    snippet = F.when(repo, F.concat(text("i.description"), F.lit(" (★ "), F.col("i.stargazers_count").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("GitHub issue ("), text("i.state"), F.lit(")")))
    named = F.when(repo, text("i.full_name")).otherwise(text("i.title")) != ""
    return _hits(i, "github", title, url, "github.com", snippet, _is_http(url) & named)


def hackernews(payloads: DataFrame) -> DataFrame:
    i = _items(payloads, "hits array<struct<url:string,story_url:string,objectID:string,title:string,points:bigint,num_comments:bigint>>", "hits")
    own = _text(F.coalesce("i.url", "i.story_url"))
    url, title = F.when(own != "", own).otherwise(F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("i.objectID"))), _text("i.title")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    snippet = F.concat(F.lit("Hacker News: "), number("i.points"), F.lit(" points, "), number("i.num_comments"), F.lit(" comments"))
    return _hits(i, "hackernews", title, url, "news.ycombinator.com", snippet, url.isNotNull() & _is_http(url) & (title != ""))


def _entries(payloads: DataFrame, mark: str, most: int) -> DataFrame:
    parts = F.slice(F.split("payload", mark), 2, most)
    return payloads.select("query_id", F.posexplode(parts).alias("pos", "i"))


def _tag(tag: str) -> Column:
    return trim_ws(F.regexp_extract("i", rf"(?s)<{tag}>(.*?)</{tag}>", 1))


def arxiv(payloads: DataFrame) -> DataFrame:
    """The first five entries of an Atom feed, before any are left out."""
    i = _entries(payloads, "<entry>", 5)
    flat = lambda tag: F.array_join(words(_tag(tag)), " ")
    return _hits(i, "arxiv", flat("title"), _tag("id"), "arxiv.org", F.left(flat("summary"), F.lit(300)), (flat("title") != "") & _is_http(_tag("id")))


def news_rss(payloads: DataFrame) -> DataFrame:
    """The first eight items of a feed; titles end in " - Publisher"."""
    i = _entries(payloads, "<item>", 8)
    plain = lambda tag: trim_ws(F.regexp_replace(F.regexp_replace(_tag(tag), r"^(<!\[CDATA\[)+", ""), r"(\]\]>)+$", ""))
    title, date = plain("title"), plain("pubDate")
    publisher = trim_ws(F.regexp_extract(title, r"(?s)^.* - (.*)$", 1))
    snippet = F.concat_ws(" · ", F.nullif(publisher, F.lit("")), F.nullif(date, F.lit("")))
    return _hits(i, "news_rss", title, plain("link"), "", snippet, (title != "") & _is_http(plain("link")))


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "searxng": searxng, "wikipedia": wikipedia, "scholar": scholar, "stackexchange": stackexchange, "mdn": mdn, "github": github, "hackernews": hackernews,
    "arxiv": arxiv, "news_rss": news_rss,
}
JSON_PARSERS = [p for p in PARSERS if p not in ("arxiv", "news_rss")]


def parse_errors(payloads: DataFrame) -> DataFrame:
    """Rows whose payload is no JSON document."""
    return payloads.where(F.try_parse_json("payload").isNull() & F.col("payload").isNotNull())


def oversized(payloads: DataFrame, most: int = 2 * 1024 * 1024) -> DataFrame:
    """Rows (payload as binary) that are too long or no UTF-8."""
    return payloads.where((F.octet_length("payload") > most) | ~F.is_valid_utf8(F.col("payload").cast("string")))


#: How the providers spell a time filter.
TIME_CODES = {"day": "d", "week": "w", "month": "m", "year": "y"}


def request(engine: str, query: Column | str, time_filter: str = "any", searxng_url: str | None = None) -> Column:
    """The URL that asks a provider."""
    from quarry.options import InvalidConfiguration

    q = F.url_encode(F.col(query) if isinstance(query, str) else query)
    code = TIME_CODES.get(time_filter, "")
    # Addresses of public search interfaces and their parameters.
    plain = {
        "wikipedia": "https://en.wikipedia.org/w/rest.php/v1/search/page?limit=5&q=",
        "arxiv": "https://export.arxiv.org/api/query?max_results=5&sortBy=relevance&search_query=all:",
        "scholar": "https://api.semanticscholar.org/graph/v1/paper/search?limit=5&fields=title,url,abstract,year&query=",
        "stackexchange": "https://api.stackexchange.com/2.3/search/advanced?order=desc&sort=relevance&site=stackoverflow&pagesize=5&q=",
        "mdn": "https://developer.mozilla.org/api/v1/search?q=",
        "hackernews": "https://hn.algolia.com/api/v1/search?hitsPerPage=5&query=",
        "duckduckgo": "https://lite.duckduckgo.com/lite/?q=",
    }
    timed = {
        "bing": ("https://www.bing.com/search?q=", "&qft=%2Bfilterui%3Aage-1{}"),
        "yahoo": ("https://search.yahoo.com/search?p=", "&btf={}"),
        "brave": ("https://search.brave.com/search?q=", "&tf=p{}"),
        "google_wml": ("https://www.google.com/search?q=", "&tbs=qdr%3A{}"),
    }
    if engine in plain:
        return F.concat(F.lit(plain[engine]), q)
    if engine in timed:
        return F.concat(F.lit(timed[engine][0]), q, F.lit(timed[engine][1].format(code) if code else ""))
    if engine == "mojeek":
        days = {"day": 1, "week": 7, "month": 30, "year": 365}.get(time_filter)
        return F.concat(F.lit("https://www.mojeek.com/search?q="), q, F.lit(f"&t={days}" if days else ""))
    if engine == "news_rss":
        days = {"day": "1d", "week": "7d", "month": "30d", "year": "365d"}.get(time_filter)
        return F.concat(F.lit("https://news.google.com/rss/search?q="), q, F.lit(f"+when%3A{days}" if days else ""), F.lit("&hl=en-US&gl=US&ceid=US:en"))
    if engine == "github":
        return F.concat(F.lit("https://api.github.com/search/"), github_endpoint(query), F.lit("?per_page=5&q="), q)
    if engine == "searxng":
        if not searxng_url or not searxng_url.startswith(("http://", "https://")):
            raise InvalidConfiguration("searxng needs an http(s) address")
        return F.concat(F.lit(searxng_url.rstrip("/") + "/search?format=json&q="), q, F.lit(f"&time_range={time_filter}" if code else ""))
    raise InvalidConfiguration(f"no such provider: {engine}")
