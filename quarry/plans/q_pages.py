"""Queries of page scans, gates and candidates, over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexicon as lex
from quarry.functions import pages as p
from quarry.functions.expr import SPACES, sql_alower, sql_contains_any, sql_list, sql_string, sql_words
from quarry.operators import candidates as c
from quarry.plans.q_text import SAMPLE, sql_anchors, sql_distinct, sql_subjects
from quarry.plans.q_urls import SQL_KEYS

#: Pages that the gates reject, beside those of the table.
ODD = [
    ("https://x.org/a?hl=ru", "<title>Access Denied</title>"), ("https://x.org/b", "<TITLE lang=en>A &amp;amp; B &ndash; C\nrest</TITLE>"), ("https://x.org/c", "<h1>Only <b>h1</b></h1>"),
    ("https://x.org/d", "<title>open\n<p>x"), ("https://x.org/e?lr=lang_ja", "function aB(){cD=eF;gH(iJ);kL=mN[oP];} var _x=$y;"), ("https://x.org/f", "   "), ("https://x.org/g", "please enable JavaScript"),
    ("https://x.org/h", "<title></title><h1> Second &quot;title&quot; </h1>"), ("https://x.org/i", "no tags > here < at all"),
]
_ODD = ", ".join(f"({-1 - i}::BIGINT, {sql_string(u)}, {sql_string(h).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))})" for i, (u, h) in enumerate(ODD))
SQL_PAGES = f"pg AS (SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM (VALUES {_ODD}) AS t(page_id, url, html))"


def all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1 - i, u, h) for i, (u, h) in enumerate(ODD)], "page_id long, url string, html string")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").unionByName(own)


def title_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pages(spark, sf_dir).select("page_id", p.scan_tag("html", "title").alias("title"), p.scan_tag("html", "h1").alias("h1"))


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pages(spark, sf_dir).select("page_id", F.md5(p.strip_tags("html")).alias("stripped"), F.md5(p.decode_entities("html")).alias("decoded"))


def page_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = all_pages(spark, sf_dir)
    return pages.select("page_id", p.is_challenge(p.scan_tag("html", "title"), "html").alias("challenge"), p.is_code_like("html").alias("code"), p.other_script("url", F.lit("rust closures")).alias("other_script"), p.serp_challenge("html").alias("serp_challenge"))


def code_like_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", p.is_code_like("text").alias("code"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lists made of pages: page n stands in the list of provider n % 5
    for query n % 7, in the order of n; twins of every tenth page in another."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.coalesce(p.scan_tag("html", "title"), F.lit("")).alias("title"))
    steps = F.when(F.col("page_id") % 10 == 0, F.array(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0)))
    both = pages.select("page_id", F.explode(steps).alias("step"), "url", "title")
    asked = F.array(*[F.lit(SAMPLE[i]) for i in range(7)])
    engines = F.array(*map(F.lit, lex.DEFAULT_PROVIDERS))
    placed = both.select((F.col("page_id") % 7).alias("query_id"), ((F.col("page_id") + F.col("step")) % 5).cast("int").alias("batch_ord"), "page_id", "url", "title", F.lit("").alias("snippet"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query_id", "batch_ord").orderBy("page_id")) - 1
    return placed.withColumns({"pos": place, "query": F.get(asked, F.col("query_id").cast("int")), "engine": F.get(engines, F.col("batch_ord"))})


def interleave_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.interleaved(hits(spark, sf_dir)).select("query_id", "ord", "page_id", "engine", "url_key")


def consensus_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.consensus(hits(spark, sf_dir))


def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.ordered(c.firsts(hits(spark, sf_dir)), 8).select("query_id", "fetch_ord", "page_id", "candidate_score")


_TRIM = f"regexp_replace({{x}}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def _decoded(x: str) -> str:
    for entity, plain in lex.ENTITIES:
        x = f"replace({x}, {sql_string(entity)}, {sql_string(plain)})"
    return x


def sql_scan(html: str, tag: str) -> str:
    closed = rf"regexp_extract({html}, '(?s)<(?i:{tag})[^>]*>(.*?)</(?i:{tag})>', 1)"
    open_ = rf"regexp_extract({html}, '<(?i:{tag})[^>]*>([^<\n]*)', 1)"
    text = rf"CASE WHEN regexp_matches({html}, '(?s)<(?i:{tag})[^>]*>.*?</(?i:{tag})>') THEN {closed} ELSE {open_} END"
    line = f"string_split({_decoded(_TRIM.format(x=text))}, chr(10))[1]"
    return f"nullif({_TRIM.format(x=line)}, '')"


def _code_sql(x: str) -> str:
    s = f"left({x}, {p.CODE_CHARS})"
    signs = rf"(length(regexp_replace({s}, '[^{{}};=()\[\]$_]', '', 'g'))::DOUBLE / length({s}))"
    names = f"((len(regexp_extract_all({s}, '[a-z][A-Z]')) + length(regexp_replace({s}, '[^_.]', '', 'g')))::DOUBLE / greatest(len({sql_words(s)}), 1))"
    lines = f"len(string_split(regexp_replace({s}, '\\n$', ''), chr(10)))"
    minified = f"(length({s})::DOUBLE / {lines} > 500 AND {signs} > 0.08)"
    return f"CASE WHEN {_TRIM.format(x=s)} = '' THEN false ELSE ({signs} > 0.12)::INT + ({names} > 0.6)::INT + {minified}::INT >= 2 END"


_ENGINES = sql_list(lex.DEFAULT_PROVIDERS)
SQL_HITS = f"""{SQL_KEYS}, hp AS (SELECT p.page_id, p.url, coalesce({sql_scan('p.html', 'title')}, '') AS title, k.key, k.apex, k.domain FROM pages p JOIN k USING (page_id)),
hb AS (SELECT *, 0 AS step FROM hp UNION ALL SELECT *, 3 FROM hp WHERE page_id % 10 = 0),
h AS (SELECT *, page_id % 7 AS query_id, ((page_id + step) % 5)::INT AS batch_ord, {sql_list(SAMPLE[:7])}[(page_id % 7) + 1] AS query, {_ENGINES}[((page_id + step) % 5) + 1] AS engine FROM hb),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id, batch_ord ORDER BY page_id) - 1 AS pos FROM h),
firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY pos, batch_ord) = 1),
inter AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, batch_ord)::INT AS ord FROM firsts)"""

_DOMAINS = "flatten([" + ", ".join(f"CASE WHEN contains({sql_alower('query')}, {sql_string(m)}) THEN {sql_list(d)} ELSE [] END" for m, d in lex.INTENT_DOMAINS.items()) + "])"
_SCORED = f"""{SQL_HITS}, t0 AS (SELECT *, {sql_alower("url || ' ' || title || ' '")} AS hay, {sql_alower('title')} AS tl, {sql_anchors('query')} AS anchors0, {sql_subjects('query')} AS subjects0, {_DOMAINS} AS domains FROM inter),
t1 AS (SELECT *, {sql_distinct('anchors0')} AS anchors, {sql_distinct('subjects0')} AS subjects FROM t0),
sc AS (SELECT *, CASE WHEN len(anchors) + len(subjects) + len(domains) = 0 THEN 0 ELSE
  CASE WHEN len(subjects) > 0 AND ({sql_contains_any(sql_alower('url'), lex.HEAD_STUBS)} OR (list_contains({sql_list(lex.STUB_TITLES)}, tl) AND {sql_contains_any(sql_alower('url'), lex.STUB_WIKI_URLS)})) THEN -20 ELSE 0 END
  + coalesce(list_sum(list_transform(anchors, lambda a: CASE WHEN contains(tl, a) THEN 6 WHEN contains(hay, a) THEN 3 ELSE 0 END)), 0)
  + coalesce(list_sum(list_transform(subjects, lambda s: CASE WHEN NOT contains(hay, s) THEN 0 WHEN list_contains({sql_list(lex.METRIC_WORDS)}, s) THEN 1 WHEN contains(tl, s) THEN 4 ELSE 2 END)), 0)
  + CASE WHEN len(list_filter(subjects, lambda s: contains(tl, s))) >= 2 THEN 4 ELSE 0 END + CASE WHEN len(list_filter(domains, lambda d: contains(hay, d))) > 0 THEN 1 ELSE 0 END
  - CASE WHEN {sql_contains_any(sql_alower('query'), lex.DISCUSSION_WORDS)} AND contains(url, 'wikipedia.org') THEN 2 ELSE 0 END END AS score FROM t1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM sc),
a AS (SELECT *, CASE WHEN n <= 8 THEN 1 ELSE row_number() OVER (PARTITION BY query_id, apex ORDER BY r) END AS turn FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, r)::INT AS fetch_ord FROM a WHERE turn <= 2)"""

QUERIES = {
    "title_scan": title_scan, "html_strip": html_strip, "page_gates": page_gates, "code_like_documents": code_like_documents,
    "interleave_dedupe": interleave_dedupe, "consensus_urls": consensus_urls, "candidate_order": candidate_order,
}
ORACLES = {
    "title_scan": f"WITH {SQL_PAGES} SELECT page_id, {sql_scan('html', 'title')} AS title, {sql_scan('html', 'h1')} AS h1 FROM pg",
    "html_strip": f"WITH {SQL_PAGES} SELECT page_id, md5(replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '>', '')) AS stripped, md5({_decoded('html')}) AS decoded FROM pg",
    "page_gates": f"""WITH {SQL_PAGES} SELECT page_id, {sql_contains_any(sql_alower(f"coalesce({sql_scan('html', 'title')}, '')"), lex.CHALLENGE_MARKERS)} OR {sql_contains_any(sql_alower('left(html, 2000)'), lex.CHALLENGE_MARKERS)} AS challenge,
      {_code_sql('html')} AS code, {sql_contains_any(sql_alower('url'), lex.OTHER_SCRIPT_MARKERS)} AS other_script, regexp_matches({sql_alower('left(html, 4000)')}, 'anomaly|captcha|challenge-form') AS serp_challenge FROM pg""",
    "code_like_documents": f"SELECT doc_id, {_code_sql('text')} AS code FROM documents",
    "interleave_dedupe": f"WITH {SQL_HITS} SELECT query_id, ord, page_id, engine, key AS url_key FROM inter",
    "consensus_urls": f"WITH {SQL_HITS} SELECT query_id, key AS url_key FROM hits GROUP BY query_id, key HAVING count(DISTINCT CASE WHEN engine IN ('duckduckgo', 'bing', 'yahoo') THEN 'bing' ELSE engine END) >= 2",
    "candidate_order": f"WITH {_SCORED} SELECT query_id, fetch_ord, page_id, score::INT AS candidate_score FROM f WHERE fetch_ord <= 8",
}
