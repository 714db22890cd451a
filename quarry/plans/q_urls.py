"""Queries of URL keys and domains, over the URLs of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexicon as lex
from quarry.functions import urls
from quarry.functions.expr import sql_alower, sql_list, sql_string

#: URLs that take the branches which the table's URLs do not.
SAMPLE = [
    "https://www.docs.rs/ratatui/index.html", "https://docs.rs/ratatui/", "http://www.www.Example.co.uk:8080/A/B/?UTM_source=x&b=2&ref=y#frag", "not a url",
    "https://a.b.c.com.au/index.htm", "https://example.org?_ga=1", "ftp://files.example.com/x/", "https://user:pw@shop.example.de/p?q=1&&fbclid=2", "  HTTPS://News.Example.com/  ", "",
]
#: Redirect links of result pages.
LINKS = [
    "//duckduckgo.com/l/?uddg=https%3A%2F%2Fexample.com%2Fa%20b&rut=1", "https://example.com/plain", "https://www.bing.com/ck/a?!&&p=1&u=a1aHR0cHM6Ly9leGFtcGxlLmNvbS9wYWdl&ntb=1",
    "https://www.bing.com/cr?rurl=https%3a%2f%2fexample.org%2f", "https://r.search.yahoo.com/_ylt=A/RV=2/RU=https%3a%2f%2fexample.net%2fx/RK=2/RS=z", "/url?q=https://example.com/q&sa=U",
    "https://www.google.com/url?url=https%3A%2F%2Fexample.com%2Fu", "https://www.google.com/search?q=x", "/relative", "https://me:pw@example.com/",
]


def urls_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(SAMPLE)], "page_id long, url string")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").unionByName(own)


def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls_of(spark, sf_dir).select("page_id", urls.canonical_url("url").alias("canonical"), urls.url_key("url").alias("key"), urls.domain("url").alias("domain"), urls.apex_domain("url").alias("apex"))


def unwrapped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = spark.createDataFrame([(i, x) for i, x in enumerate(LINKS)], "link_id int, href string")
    return links.select("link_id", urls.unwrap_uddg("href").alias("uddg"), urls.unwrap_base64("href").alias("base64"), urls.unwrap_ru("href").alias("ru"), urls.unwrap_url_param("href").alias("param"))


SQL_URLS = f"""u AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM (VALUES {", ".join(f"({-1 - i}::BIGINT, {sql_string(x)})" for i, x in enumerate(SAMPLE))}))"""
_PATTERN = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?(#.*)?$"

#: Common table expressions that end in k(page_id, url, canonical, key, domain, apex).
SQL_KEYS = rf"""{SQL_URLS}, p0 AS (SELECT page_id, url, trim(url) AS t, regexp_extract(trim(url), '{_PATTERN}', 1) AS scheme, regexp_extract(trim(url), '{_PATTERN}', 2) AS auth,
    regexp_extract(trim(url), '{_PATTERN}', 3) AS path, regexp_extract(trim(url), '{_PATTERN}', 5) AS query FROM u),
p1 AS (SELECT *, lower(regexp_replace(regexp_replace(auth, '^.*@', ''), ':[0-9]*$', '')) AS host FROM p0),
p2 AS (SELECT *, scheme <> '' AND host <> '' AS ok, regexp_replace(host, '^(www\.)+', '') AS bare,
    list_filter(string_split(query, '&'), lambda p: NOT starts_with({sql_alower("split_part(p, '=', 1)")}, 'utm_') AND NOT list_contains({sql_list(lex.TRACKING_PARAMS)}, {sql_alower("split_part(p, '=', 1)")})) AS kept FROM p1),
p3 AS (SELECT *, CASE WHEN query = '' OR len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS kq, list_filter(kept, lambda p: p <> '') AS kept1, CASE WHEN path = '' THEN '/' ELSE path END AS path1 FROM p2),
p4 AS (SELECT *, string_split(bare, '.') AS labels FROM p3),
k AS (SELECT page_id, url, CASE WHEN ok THEN lower(scheme) || '://' || lower(auth) || CASE WHEN length(path1) > 1 THEN regexp_replace(path1, '/$', '') ELSE path1 END || CASE WHEN query = '' OR len(kept1) = 0 THEN '' ELSE '?' || array_to_string(kept1, '&') END ELSE lower(t) END AS canonical,
    CASE WHEN ok THEN bare || lower(regexp_replace(regexp_replace(regexp_replace(path, '/+$', ''), '(/index\.html)+$', ''), '(/index\.htm)+$', '')) || kq ELSE lower(t) END AS key,
    CASE WHEN ok THEN bare ELSE '' END AS domain,
    CASE WHEN NOT ok THEN '' WHEN len(labels) <= 2 THEN bare WHEN length(labels[-1]) = 2 AND list_contains({sql_list(lex.SECOND_LEVEL)}, labels[-2]) THEN labels[-3] || '.' || labels[-2] || '.' || labels[-1]
      ELSE labels[-2] || '.' || labels[-1] END AS apex FROM p4)"""

_LINKS = ", ".join(f"({i}, {sql_string(x)})" for i, x in enumerate(LINKS))
QUERIES = {"url_keys": url_keys, "unwrapped_links": unwrapped_links}
ORACLES = {
    "url_keys": f"WITH {SQL_KEYS} SELECT page_id, canonical, key, domain, apex FROM k",
    "unwrapped_links": rf"""WITH l AS (SELECT * FROM (VALUES {_LINKS}) AS t(link_id, href)),
w AS (SELECT *, CASE WHEN starts_with(href, '/url?') THEN 'https://www.google.com' || href WHEN regexp_matches(href, '^https?://') THEN href END AS whole FROM l),
x AS (SELECT *, CASE WHEN regexp_matches(whole, '^https?://(www\.)?google\.com/url\?') THEN url_decode(regexp_extract(whole, '[?&](q|url)=([^&#]*)', 2)) ELSE whole END AS target FROM w)
SELECT link_id, CASE WHEN contains(href, 'uddg=') THEN url_decode(regexp_extract(href, '[?&]uddg=([^&#]*)', 1)) ELSE href END AS uddg,
  CASE WHEN contains(href, '/ck/a') OR contains(href, '/cr?') THEN CASE WHEN contains(href, 'rurl=') THEN url_decode(regexp_extract(href, '[?&]rurl=([^&#]*)', 1))
    ELSE decode(from_base64(rpad(regexp_replace(regexp_extract(href, '[?&]u=([^&#]*)', 1), '^a1', ''), (ceil(length(regexp_replace(regexp_extract(href, '[?&]u=([^&#]*)', 1), '^a1', '')) / 4.0) * 4)::INT, '='))) END ELSE href END AS base64,
  CASE WHEN contains(href, '/RU=') THEN url_decode(regexp_extract(href, '/RU=(.*?)/RK=', 1)) ELSE href END AS ru,
  CASE WHEN regexp_matches(target, '^https?://[^/?#]') AND NOT contains(target, '@') AND NOT regexp_matches(target, '^https?://(www\.)?google\.com/(search|wml/search|url|preferences|sorry/?)([?#]|$)') THEN target END AS param FROM x""",
}
