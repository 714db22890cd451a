"""Queries of payload parsers and of egress rules, over inline rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.expr import SPACES, sql_string
from quarry.functions.lexicon import DENIED_V4
from quarry.operators import egress
from quarry.sources import payloads as s

PAYLOADS = {
    "searxng": {"results": [{"url": " https://a.org/1 ", "title": "One", "content": " first "}, {"url": "ftp://a.org", "title": "No"}, {"url": "https://a.org/2", "title": "  "}, {"url": "https://a.org/3", "title": "Three"}]},
    "wikipedia": {"pages": [{"key": "Gold_(metal)", "title": "", "excerpt": "<b>Gold</b> is", "description": "element"}, {"key": " ", "title": "x"}, {"key": "Iron", "title": "Iron", "excerpt": "<i></i>", "description": "metal"}, {"key": "Tin", "title": "Tin"}]},
    "scholar": {"data": [{"title": "Paper", "url": "https://s.org/p", "abstract": "long " * 60, "year": 2020}, {"title": "No year", "url": "https://s.org/q"}, {"title": "", "url": "https://s.org/r"}, {"title": "x", "url": "doi:1"}]},
    "stackexchange": {"items": [{"title": "How?", "link": "https://so.com/1", "score": 5, "answer_count": 2, "is_answered": True}, {"title": "Why?", "link": "https://so.com/2"}, {"title": "", "link": "https://so.com/3"}]},
    "mdn": {"documents": [{"title": "Fetch", "mdn_url": "/en-US/docs/fetch", "summary": " API "}, {"title": "x", "mdn_url": ""}]},
    "github": {"items": [{"html_url": "https://github.com/a/b", "stargazers_count": 7, "description": "tool", "full_name": "a/b"}, {"html_url": "https://github.com/a/b/issues/1", "repository_url": "https://api.github.com/repos/a/b", "title": "crash", "state": "open"}, {"html_url": "x", "title": "t"}, {"html_url": "https://github.com/c", "stargazers_count": 1, "full_name": ""}]},
    "hackernews": {"hits": [{"url": "https://n.org", "title": "News", "points": 3, "num_comments": 4}, {"story_url": "https://n.org/s", "title": "Story"}, {"objectID": "42", "title": "Ask"}, {"title": "none"}, {"url": "https://n.org/x", "title": ""}]},
}
ATOM = "<feed><entry><id> https://arxiv.org/abs/1 </id><title>A\n  long   title</title><summary> s1\n s2 </summary></entry><entry><id>urn:1</id><title>no</title></entry><entry><id>https://arxiv.org/abs/2</id><title>B</title></entry></feed>"
RSS = "<rss><item><title><![CDATA[Big - news - The Paper]]></title><link>https://p.org/1</link><pubDate>Mon</pubDate></item><item><title>Plain</title><link>https://p.org/2</link><pubDate>Tue</pubDate></item><item><title>X - Y</title><link>https://p.org/3</link></item><item><title></title><link>https://p.org/4</link></item></rss>"
IPS = ["8.8.8.8", "127.0.0.1", "10.1.2.3", "172.15.0.1", "172.16.0.1", "172.31.255.255", "172.32.0.1", "192.168.1.1", "169.254.169.254", "100.63.0.1", "100.64.0.1", "100.128.0.1", "192.0.2.1", "192.0.3.1", "198.18.0.1", "198.19.9.9", "198.20.0.1", "203.0.113.9", "224.0.0.1", "239.1.1.1", "240.0.0.1", "255.255.255.255", "0.0.0.0", "1.1.1.1", "300.1.1.1", "not an ip"]
WEB = [("https://a.example.com/x", 301, "/y", None), ("https://a.example.com/y", 302, "z?q=1", None), ("https://a.example.com/z?q=1", 200, None, "done"), ("http://b.example.com/", 301, "ftp://c.example.com", None), ("https://loop.example.com/1", 301, "//loop.example.com/1", None), ("https://c.example.com/", 307, None, None), ("https://d.example.com/", 404, None, "no"), ("https://e.example.com/", 302, "http://inside.example.com/", None), ("http://inside.example.com/", 200, None, "secret")]
START = ["https://a.example.com/x", "http://b.example.com/", "https://loop.example.com/1", "https://c.example.com/", "https://d.example.com/", "https://e.example.com/", "ftp://a.example.com", "nonsense", "https://unknown.example.com/"]


def _payload(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(1, "q", text), (2, "q", "not json"), (3, "q", None)], "query_id long, query string, payload string")


def _parsed(name: str):
    text = ATOM if name == "arxiv" else RSS if name == "news_rss" else json.dumps(PAYLOADS[name])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return s.PARSERS[name](_payload(spark, text)).select("query_id", F.col("pos").cast("long").alias("pos"), "title", "url", "display_url", "snippet", "engine")

    return run


def ssrf_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in IPS], "ip string").select("ip", egress.safe_v4("ip").alias("safe"))


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = spark.createDataFrame([(*r, "text/html") for r in WEB], "url string, status int, location string, body string, content_type string")
    hosts = spark.createDataFrame([(f"{h}.example.com", h != "inside") for h in ("a", "b", "c", "d", "e", "loop", "inside")], "host string, safe boolean")
    start = spark.createDataFrame([(u,) for u in START], "url string")
    return egress.followed(start, web, hosts).select("url", "final_url", "hop_count", "body", "error")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.createDataFrame([("how to fix error & bug",)], "query string")
    urls = [F.struct(F.lit(p).alias("engine"), s.request(p, "query", "week", "https://s.example.com/").alias("url")) for p in ("duckduckgo", "bing", "yahoo", "mojeek", "google_wml", "brave", "searxng", "wikipedia", *s.PARSERS) if p]
    return one.select(F.explode(F.array_distinct(F.array(*urls))).alias("r")).select("r.engine", "r.url")


def _trim(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def _json_sql(name: str, field: str, title: str, url: str, display: str, snippet: str, keep: str) -> str:
    g = lambda k: f"(i->>'$.{k}')"
    for k in ("url", "title", "content", "key", "excerpt", "description", "abstract", "year", "link", "score", "answer_count", "is_answered", "mdn_url", "summary", "html_url", "stargazers_count", "full_name", "repository_url", "state", "story_url", "objectID", "points", "num_comments"):
        title, url, display, snippet, keep = (x.replace(f"@{k}@", g(k)) for x in (title, url, display, snippet, keep))
    return f"""WITH j AS (SELECT unnest(json_extract({sql_string(json.dumps(PAYLOADS[name]))}::JSON, '$.{field}[*]')) AS i, generate_subscripts(json_extract({sql_string(json.dumps(PAYLOADS[name]))}::JSON, '$.{field}[*]'), 1) - 1 AS pos)
SELECT 1::BIGINT AS query_id, pos::BIGINT AS pos, {_trim(title)} AS title, {_trim(url)} AS url, {_trim(display)} AS display_url, {_trim(snippet)} AS snippet, '{name}' AS engine FROM j WHERE {keep}"""


def _feed_sql(name: str, text: str, mark: str, most: int, title: str, url: str, display: str, snippet: str) -> str:
    literal = sql_string(text).replace("\n", "' || chr(10) || '")
    return f"""WITH e AS (SELECT unnest(string_split({literal}, '{mark}')[2:{most + 1}]) AS i, generate_subscripts(string_split({literal}, '{mark}')[2:{most + 1}], 1) - 1 AS pos),
x AS (SELECT pos, {title} AS title, {url} AS url, {snippet} AS snippet FROM e) SELECT 1::BIGINT AS query_id, pos::BIGINT AS pos, title, url, '{display}' AS display_url, snippet, '{name}' AS engine FROM x WHERE title <> '' AND starts_with(url, 'http')"""


def _tag(tag: str) -> str:
    return _trim(f"regexp_extract(i, '(?s)<{tag}>(.*?)</{tag}>', 1)")


def _plain(tag: str) -> str:
    return _trim(rf"regexp_replace(regexp_replace({_tag(tag)}, '^(<!\[CDATA\[)+', ''), '(\]\]>)+$', '')")


def _flat(tag: str) -> str:
    return f"regexp_replace({_tag(tag)}, '[{SPACES}]+', ' ', 'g')"


def _cidr(net: str) -> str:
    import ipaddress

    n = ipaddress.ip_network(net)
    return f"n BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}"


_OK = f"starts_with({_trim('@url@')}, 'http') AND {_trim('@title@')} <> ''"
_PUB = f"{_trim(rf'''regexp_extract({_plain('title')}, '(?s)^.* - (.*)$', 1)''')}"
QUERIES = {f"parse_{p}": _parsed(p) for p in s.PARSERS} | {"ssrf_v4": ssrf_v4, "redirects": redirects, "provider_requests": requests}
ORACLES = {
    "parse_searxng": _json_sql("searxng", "results", "@title@", "@url@", "''", "@content@", _OK),
    "parse_wikipedia": _json_sql("wikipedia", "pages", f"CASE WHEN {_trim('@title@')} = '' THEN replace(@key@, '_', ' ') ELSE @title@ END", "'https://en.wikipedia.org/wiki/' || @key@", "'en.wikipedia.org/wiki/' || @key@", f"CASE WHEN {_trim('regexp_replace(@excerpt@, $$<[^>]*(>|$)$$, $$$$, $$g$$)')} <> '' THEN regexp_replace(@excerpt@, $$<[^>]*(>|$)$$, $$$$, $$g$$) ELSE @description@ END".replace("$$<[^>]*(>|$)$$", "'<[^>]*(>|$)'").replace("$$$$", "''").replace("$$g$$", "'g'"), f"{_trim('@key@')} <> ''"),
    "parse_scholar": _json_sql("scholar", "data", "@title@", "@url@", "'semanticscholar.org'", "left(coalesce(@abstract@, ''), 220) || ' (' || coalesce(@year@, '') || ')'", _OK),
    "parse_stackexchange": _json_sql("stackexchange", "items", "@title@", "@link@", "'stackoverflow.com'", "'Stack Overflow: score ' || coalesce(@score@, '0') || ', ' || coalesce(@answer_count@, '0') || ' answers' || CASE WHEN @is_answered@ = 'true' THEN ', accepted answer' ELSE '' END", f"starts_with({_trim('@link@')}, 'http') AND {_trim('@title@')} <> ''"),
    "parse_mdn": _json_sql("mdn", "documents", "@title@", f"'https://developer.mozilla.org' || {_trim('@mdn_url@')}", "'developer.mozilla.org'", "@summary@", f"{_trim('@mdn_url@')} <> '' AND {_trim('@title@')} <> ''"),
    "parse_github": _json_sql("github", "items", "CASE WHEN @stargazers_count@ IS NOT NULL THEN @full_name@ ELSE replace(coalesce(@repository_url@, ''), 'https://api.github.com/repos/', '') || ': ' || @title@ END", "@html_url@", "'github.com'", "CASE WHEN @stargazers_count@ IS NOT NULL THEN coalesce(@description@, '') || ' (★ ' || @stargazers_count@ || ')' ELSE 'GitHub issue (' || coalesce(@state@, '') || ')' END", "starts_with(@html_url@, 'http') AND coalesce(CASE WHEN @stargazers_count@ IS NOT NULL THEN @full_name@ ELSE @title@ END, '') <> ''"),
    "parse_hackernews": _json_sql("hackernews", "hits", "@title@", "coalesce(nullif(coalesce(@url@, @story_url@), ''), 'https://news.ycombinator.com/item?id=' || @objectID@)", "'news.ycombinator.com'", "'Hacker News: ' || coalesce(@points@, '0') || ' points, ' || coalesce(@num_comments@, '0') || ' comments'", "coalesce(@url@, @story_url@, @objectID@) IS NOT NULL AND @title@ <> ''"),
    "parse_arxiv": _feed_sql("arxiv", ATOM, "<entry>", 5, _flat("title"), _tag("id"), "arxiv.org", f"left({_flat('summary')}, 300)"),
    "parse_news_rss": _feed_sql("news_rss", RSS, "<item>", 8, _plain("title"), _plain("link"), "", f"concat_ws(' · ', nullif({_PUB}, ''), nullif({_plain('pubDate')}, ''))"),
    "ssrf_v4": f"""WITH i AS (SELECT unnest([{", ".join(map(sql_string, IPS))}]) AS ip), o AS (SELECT ip, CASE WHEN regexp_full_match(ip, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}') THEN list_transform(string_split(ip, '.'), lambda x: x::BIGINT) END AS o FROM i),
      n AS (SELECT ip, CASE WHEN list_max(o) <= 255 THEN o[1] * 16777216 + o[2] * 65536 + o[3] * 256 + o[4] END AS n FROM o) SELECT ip, NOT ({" OR ".join(map(_cidr, DENIED_V4))}) AS safe FROM n""",
    # A hop is a step of the recursion; a page that leads nowhere ends it.
    "redirects": f"""WITH RECURSIVE web AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else sql_string(x) for x in r) + ")" for r in WEB)}) AS t(u, status, location, body)),
      s AS (SELECT unnest([{", ".join(map(sql_string, START))}]) AS url),
      f AS (SELECT url, url AS here, 0 AS hop, NULL::VARCHAR AS body, NULL::VARCHAR AS error, false AS done FROM s
        UNION ALL SELECT url, CASE WHEN e IS NULL AND redirect THEN target ELSE here END, hop + 1, CASE WHEN e IS NULL AND NOT redirect THEN b END, e, e IS NOT NULL OR NOT redirect FROM (
          SELECT *, CASE WHEN NOT regexp_matches(here, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'invalid url' WHEN NOT regexp_matches(here, '^https?:') THEN 'unsupported scheme' WHEN NOT safe THEN 'blocked address' WHEN u IS NULL THEN 'no answer'
            WHEN redirect AND hop >= {egress.MAX_HOPS} THEN 'too many redirects' WHEN redirect AND location IS NULL THEN 'redirect without location' WHEN redirect AND NOT regexp_matches(target, '^https?://') THEN 'unsupported scheme'
            WHEN NOT redirect AND NOT status BETWEEN 200 AND 299 THEN 'status ' || status END AS e
          FROM (SELECT f.url, f.here, f.hop, w.u, w.status, w.location, w.body AS b, coalesce(w.status BETWEEN 300 AND 399, false) AS redirect,
              regexp_extract(f.here, '//([^/?#]*)', 1) IN ('a.example.com', 'b.example.com', 'c.example.com', 'd.example.com', 'e.example.com', 'loop.example.com') AS safe,
              CASE WHEN regexp_matches(w.location, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN w.location WHEN starts_with(w.location, '//') THEN regexp_extract(f.here, '^[^:]+:') || w.location
                WHEN starts_with(w.location, '/') THEN regexp_extract(f.here, '^[^:]+://[^/?#]*') || w.location ELSE regexp_extract(f.here, '^[^?#]*/') || w.location END AS target
            FROM f LEFT JOIN web w ON w.u = f.here WHERE NOT f.done)))
      SELECT url, here AS final_url, hop::INT AS hop_count, body, error FROM f WHERE done""",
}
