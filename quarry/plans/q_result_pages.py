"""Queries of HTML result pages, IPv6 addresses and dense scores, with SQL."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.expr import sql_string
from quarry.functions.lexicon import DENIED_V4, DENIED_V6
from quarry.operators import egress, ranking
from quarry.plans.q_rank import ASKED, _chunk_sql, _passages
from quarry.sources import serp

_UDDG = ["//duckduckgo.com/l/?uddg=https%3A%2F%2Fe.org%2F1%3Fa%3Db&rut=x", "https://e.org/2", "https://e.org/3"]
_RU = ["https://r.search.yahoo.com/_ylt=A/RV=2/RU=https%3a%2f%2fe.org%2f1/RK=2/RS=z", "https://www.e.org/2", "https://e.org/3"]
_PLAIN = ["https://e.org/1", "https://sub.e.org/2?q=1", "https://e.org/3"]
_INSIDE = ["/url?q=https://e.org/1&sa=U", "/search?q=more", "https://e.org/1", "https://e.org/4", "/url?q=https%3A%2F%2Fe.org%2F5"]
_BOX = {
    "duckduckgo_lite": "<tr><td><a class='result-link' href='{h}'>{t}</a></td></tr><tr><td class='result-snippet'>{s}</td></tr>",
    "duckduckgo": "<div class='result results_links results_links_deep web-result'><h2 class='result__title'><a class='result__a' href='{h}'>{t}</a></h2><a class='result__url'>e.org</a><a class='result__snippet'>{s}</a></div>",
    "yahoo": "<div class='dd algo'><div class='compTitle'><a href='{h}'><h3>{t}</h3></a></div><div class='compText'><p>{s}</p></div></div>",
    "mojeek": "<li><a class='ob' href='{h}'>x</a><h2><a>{t}</a></h2><p class='s'>{s}</p></li>",
    "google_wml": "<div class='zMzFAb'><a class='fuLhoc' href='{h}'><span class='CVA68e'>{t}</span></a><div class='taTFJ'><span class='FrIlee'>{s}</span></div></div>",
    "brave": "<div class='snippet'><a class='result-header' href='{h}'>{t}</a><cite>e.org</cite><div class='snippet-description'>{s}</div></div>",
}
_LINKS = {"duckduckgo_lite": [*_UDDG, "javascript:x"], "duckduckgo": _UDDG, "yahoo": _RU, "mojeek": _PLAIN, "google_wml": _INSIDE, "brave": [*_PLAIN, "ftp://e.org/4"]}
_AROUND = {"duckduckgo_lite": "<table>{}</table>", "mojeek": "<ul class='results-standard'>{}</ul>"}
PAGES = {p: _AROUND.get(p, "<body>{}</body>").format("".join(_BOX[p].format(h=h, t=f"Title {i} &amp; more", s=f"text {i}") for i, h in enumerate(_LINKS[p]))) for p in _BOX}
V6 = ["::1", "::", "2001:4860:4860::8888", "fe80::1", "fec0::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::10.1.1.1", "::8.8.8.8", "fc00::1", "fdff::", "2002::1", "2001:db8::1", "2001:0:1::2", "64:ff9b::1", "ff02::1", "100::1", "2606:4700:4700::1111", "1:2:3:4:5:6:7:8", "bad:", "1::2::3", "12345::1"]
LETTERS = "abcdefgh"


def _parsed(page: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.createDataFrame([(1, PAGES[page]), (2, ""), (3, None)], "query_id long, payload string")
        return serp.hits(rows, page).withColumn("pos", F.col("pos").cast("long"))

    return run


def ssrf_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egress.with_safety(spark.createDataFrame([(x,) for x in V6], "ip string")).select("ip", "safe")


def letter_counts(texts: list[str]) -> list[list[float]]:
    """An embedder that SQL can repeat: how often eight letters occur, plus one."""
    return [[1.0 + (t or "").count(x) for x in LETTERS] for t in texts]


def dense_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of every document with its cosine to each query."""
    own = ranking.embedded(_passages(spark, sf_dir), letter_counts, "text", "_v")
    asked = ranking.embedded(spark.createDataFrame(ASKED, "query_id int, query string"), letter_counts, "query", "_q")
    q = F.array(*[F.struct(F.lit(r["query_id"]).alias("query_id"), F.array(*map(F.lit, r["_q"])).alias("_q")) for r in asked.collect()])
    both = own.withColumn("_a", F.explode(q)).select("_a.*", "page_ord", "passage_index", "_v")
    scored = ranking.scaled(both.withColumn("score", ranking.cosine("_v", "_q")), "dense")
    return scored.select("query_id", F.col("page_ord").alias("doc_id"), F.col("passage_index").cast("long").alias("passage_index"), F.round("score", 4).alias("score"))


def _page_sql(page: str) -> str:
    mark = {"duckduckgo_lite": "class=''result-link''", "duckduckgo": "class=''result__a''", "yahoo": "class=''compTitle''", "mojeek": "class=''ob''", "google_wml": "class=''fuLhoc''", "brave": "class=''result-header''"}[page]
    title = {"yahoo": "<h3>([^<]*)<", "mojeek": "<h2><a>([^<]*)<", "google_wml": "CVA68e''>([^<]*)<"}.get(page, "^[^>]*>([^<]*)<")
    snippet = {"yahoo": "<p>([^<]*)<", "mojeek": "<p class=''s''>([^<]*)<", "google_wml": "FrIlee''>([^<]*)<", "brave": "description''>([^<]*)<"}.get(page, "snippet''>([^<]*)<")
    url = {
        "duckduckgo_lite": "CASE WHEN contains(href, 'uddg=') THEN url_decode(regexp_extract(href, '[?&]uddg=([^&#]*)', 1)) ELSE href END",
        "yahoo": "CASE WHEN contains(href, '/RU=') THEN url_decode(regexp_extract(href, '/RU=(.*?)/RK=', 1)) ELSE href END",
        "google_wml": "CASE WHEN starts_with(href, '/url?') THEN url_decode(regexp_extract(href, '[?&]q=([^&]*)', 1)) WHEN starts_with(href, 'http') THEN href END",
    }
    target = url["duckduckgo_lite"] if page == "duckduckgo" else url.get(page, "href")
    display = {"duckduckgo_lite": "''", "duckduckgo": "'e.org'", "brave": "'e.org'"}.get(page, "regexp_extract(url, '^https?://([^/?#]+)', 1)")
    once = " QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1" if page == "google_wml" else ""
    return f"""WITH h AS (SELECT string_split({sql_string(PAGES[page])}, '{mark}')[2:] AS parts),
e AS (SELECT unnest(parts) AS i, generate_subscripts(parts, 1) - 1 AS pos FROM h),
x AS (SELECT pos, replace(regexp_extract(i, '{title}', 1), '&amp;', '&') AS title, regexp_extract(i, 'href=''([^'']*)''', 1) AS href, regexp_extract(i, '{snippet}', 1) AS snippet FROM e),
u AS (SELECT *, {target} AS url FROM x)
SELECT 1::BIGINT AS query_id, pos::BIGINT AS pos, title, url, {display} AS display_url, snippet, '{"duckduckgo" if page == "duckduckgo_lite" else page}' AS engine FROM u WHERE starts_with(url, 'http'){once}"""


def _within(column: str, nets: list[str], digits: int) -> str:
    bounds = [(ipaddress.ip_network(n)[0], ipaddress.ip_network(n)[-1]) for n in nets]
    return "(" + " OR ".join(f"{column} BETWEEN '{int(a):0{digits}x}' AND '{int(b):0{digits}x}'" for a, b in bounds) + ")"


_COUNTS = lambda text: "[" + ", ".join(f"(1 + len({text}) - len(replace({text}, '{x}', '')))::DOUBLE" for x in LETTERS) + "]"
_Q = ", ".join(f"({i}, {sql_string(q)})" for i, q in ASKED)

QUERIES = {f"parse_{p}": _parsed(p) for p in PAGES} | {"ssrf_v6": ssrf_v6, "dense_rank": dense_rank}
ORACLES = {f"parse_{p}": _page_sql(p) for p in PAGES} | {
    # An address as 32 hex digits, after a dotted tail is two groups and "::" is as many zeros as are missing.
    "ssrf_v6": f"""WITH i AS (SELECT unnest([{", ".join(map(sql_string, V6))}]) AS ip),
o AS (SELECT ip, regexp_extract(ip, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') AS dotted FROM i),
t AS (SELECT ip, CASE WHEN dotted = '' THEN ip ELSE left(ip, len(ip) - len(dotted)) || printf('%x:%x', split_part(dotted, '.', 1)::INT * 256 + split_part(dotted, '.', 2)::INT, split_part(dotted, '.', 3)::INT * 256 + split_part(dotted, '.', 4)::INT) END AS a FROM o),
p AS (SELECT ip, len(string_split(a, '::')) AS n, list_filter(string_split(split_part(a, '::', 1), ':'), lambda x: x <> '' OR NOT contains(a, '::')) AS l, list_filter(string_split(split_part(a, '::', 2), ':'), lambda x: x <> '') AS r FROM t),
g AS (SELECT ip, CASE WHEN n = 1 THEN l WHEN n = 2 AND len(l) + len(r) < 8 THEN l || list_transform(range(8 - len(l) - len(r)), lambda x: '0') || r END AS g FROM p),
h AS (SELECT ip, CASE WHEN len(g) = 8 AND len(list_filter(g, lambda x: regexp_full_match(x, '[0-9a-fA-F]{{1,4}}'))) = 8 THEN lower(array_to_string(list_transform(g, lambda x: lpad(x, 4, '0')), '')) END AS h FROM g)
SELECT ip, coalesce(NOT CASE WHEN left(h, 24) = '{'0' * 20}ffff' OR left(h, 24) = '{'0' * 24}' AND h > '{1:032x}' THEN {_within('right(h, 8)', DENIED_V4, 8)} ELSE {_within('h', DENIED_V6, 32)} END, false) AS safe FROM h""",
    "dense_rank": f"""WITH {_chunk_sql()}, q AS (SELECT query_id, {_COUNTS('query')} AS v FROM (VALUES {_Q}) AS t(query_id, query)), d AS (SELECT doc_id, passage_index, {_COUNTS('text')} AS v FROM c)
SELECT query_id, doc_id, passage_index::BIGINT AS passage_index, round(least(greatest(list_cosine_similarity(d.v, q.v), 0), 1), 4) AS score FROM d, q""",
}
