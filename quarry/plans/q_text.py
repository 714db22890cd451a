"""Queries of query understanding, over the users' turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexicon as lex
from quarry.functions import understand as u
from quarry.functions.expr import sql_alower, sql_contains_any, sql_core, sql_list, sql_string, sql_words

#: Questions that are known to take every branch, beside the turns of the table.
SAMPLE = [
    "how many players are in a rugby team", "what is the capital of Australia", "how does a diesel engine work", "when did the Berlin Wall fall",
    "atomic number of gold", "Rust HTML to markdown libraries", "which year was PostgreSQL 9.6 released?", "reddit discussion of rust forum",
    "latest news about elections", 'who wrote "The Trial" in 1925', "software war", "wallpaper doing prefix", "vs code extension error panic",
    "arxiv paper on all-MiniLM-L6-v2", "polyc-egress v2026.9.6 3.75%", "c++ css grid fetch", "the", "", "How Ärger ÜBER naïve cafés", "docs.rs crates.io python guide",
    "This week today breaking", "launch of the ipo", "?", "NASA Europa's ice",
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    own = spark.createDataFrame([(-1 - i, q) for i, q in enumerate(SAMPLE)], "query_id long, query string")
    return turns.unionByName(own)


SQL_QUESTIONS = f"""q AS (SELECT conv_id * 1000 + turn AS query_id, coalesce(text, '') AS query FROM conversations WHERE role = 'user'
  UNION ALL SELECT * FROM (VALUES {", ".join(f"({-1 - i}::BIGINT, {sql_string(x)})" for i, x in enumerate(SAMPLE))}))"""


def sql_subjects(x: str) -> str:
    return f"list_filter(list_transform({sql_words(x)}, lambda w: {sql_alower(sql_core('w'))}), lambda w: strlen(w) >= 3 AND NOT list_contains({sql_list(lex.STOPWORDS)}, w))"


def sql_distinct(x: str) -> str:
    """First occurrences in order."""
    return f"list_filter({x}, lambda z, i: list_position({x}, z) = i)"


def sql_anchors(x: str) -> str:
    quoted = f"list_filter(list_transform(regexp_extract_all({x}, '\"([^\"]*)\"', 1), lambda s: {sql_alower('trim(s)')}), lambda s: s <> '')"
    ok = rf"""(strlen(t) >= 2 AND ((strlen(t) >= 3 AND (regexp_matches(t, '[0-9]') OR (regexp_matches(t, '[-/._+]') AND regexp_matches(t, '\p{{L}}'))))
      OR regexp_full_match(t, '[A-Z]{{2,}}') OR (strlen(t) >= 3 AND regexp_matches(t, '^[A-Z]') AND NOT list_contains({sql_list(lex.STOPWORDS)}, {sql_alower('t')}))))"""
    return f"list_concat({quoted}, list_transform(list_filter(list_transform({sql_words(x)}, lambda w: {sql_core('w')}), lambda t: {ok}), lambda t: {sql_alower('t')}))"


def _joined(values: str) -> str:
    return f"array_to_string({values}, '|')"


def _query(*columns) -> object:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return questions(spark, sf_dir).select("query_id", *[c().alias(n) for n, c in columns])

    return run


def _shape_sql() -> str:
    subject = f"len(list_filter(list_transform({sql_words('lq')}, lambda w: {sql_core('w')}), lambda t: strlen(t) >= 3 AND NOT list_contains({sql_list(lex.FRAMING)}, t)))"
    question = f"(contains(lq, '?') OR coalesce(list_contains({sql_list(lex.FRAMING)}, {sql_words('lq')}[1]), false))"
    return f"""CASE WHEN {subject} = 0 THEN 'not_value_seeking' WHEN {sql_contains_any('lq', lex.NUMERIC_CUES)} THEN 'numeric'
      WHEN {sql_contains_any('lq', lex.YEAR_CUES)} THEN 'year' WHEN {question} AND len({sql_anchors('query')}) > 0 THEN 'entity' ELSE 'not_value_seeking' END"""


SQL_SHAPES = f"s AS (SELECT *, {_shape_sql()} AS shape FROM (SELECT *, trim({sql_alower('query')}) AS lq FROM q))"


def _phrase_sql(phrases: list[str]) -> str:
    padded = rf"' ' || array_to_string(list_filter(string_split_regex({sql_alower('query')}, '[^\p{{L}}\p{{M}}\p{{N}}+]+'), lambda z: z <> ''), ' ') || ' '"
    return "(" + " OR ".join(f"contains({sql_alower('query')}, {sql_string(p)})" if len(p) == 1 else f"contains({padded}, {sql_string(f' {p} ')})" for p in phrases) + ")"


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", *[u.has_any_phrase("query", lex.GATES[v]).alias(v) for v in lex.VERTICALS], u.has_any_phrase("query", lex.ISSUE_WORDS).alias("asks_for_issues"))


def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    query = F.lit("how many of 1,280 Licensed")
    return docs.select("doc_id", F.array_join(F.array_sort(u.numbers("text")), "|").alias("numbers"), u.new_number("text", query).alias("new_number"), u.new_name("text", query).alias("new_name"))


_NUM = "list_distinct(list_transform(regexp_extract_all({x}, '[0-9]+(?:[,.:/][0-9]+)*'), lambda r: regexp_replace(r, '[^0-9]', '', 'g')))"

QUERIES = {
    "subject_tokens": _query(("tokens", lambda: F.array_join(u.subject_tokens("query"), "|"))),
    "entity_anchors": _query(("anchors", lambda: F.array_join(u.anchors("query"), "|"))),
    "intent_domains": _query(("domains", lambda: F.array_join(u.intent_domains("query"), "|")), ("discussion", lambda: u.discussion_intent("query"))),
    "phrase_gates": gates,
    "answer_shape": _query(("shape", lambda: u.answer_shape("query"))),
    "result_ttl": _query(("ttl", lambda: u.result_ttl("query"))),
    "text_signals": text_signals,
}

ORACLES = {
    "subject_tokens": f"WITH {SQL_QUESTIONS}, t AS (SELECT query_id, {sql_subjects('query')} AS x FROM q) SELECT query_id, {_joined(sql_distinct('x'))} AS tokens FROM t",
    "entity_anchors": f"WITH {SQL_QUESTIONS}, t AS (SELECT query_id, {sql_anchors('query')} AS x FROM q) SELECT query_id, {_joined(sql_distinct('x'))} AS anchors FROM t",
    "intent_domains": f"""WITH {SQL_QUESTIONS} SELECT query_id, array_to_string(flatten([{", ".join(f"CASE WHEN contains({sql_alower('query')}, {sql_string(m)}) THEN {sql_list(d)} ELSE [] END" for m, d in lex.INTENT_DOMAINS.items())}]), '|') AS domains,
      {sql_contains_any(sql_alower('query'), lex.DISCUSSION_WORDS)} AS discussion FROM q""",
    "phrase_gates": f"WITH {SQL_QUESTIONS} SELECT query_id, {', '.join(f'{_phrase_sql(lex.GATES[v])} AS {v}' for v in lex.VERTICALS)}, {_phrase_sql(lex.ISSUE_WORDS)} AS asks_for_issues FROM q",
    "answer_shape": f"WITH {SQL_QUESTIONS}, {SQL_SHAPES} SELECT query_id, shape FROM s",
    "result_ttl": f"""WITH {SQL_QUESTIONS} SELECT query_id, CASE WHEN list_has_any({sql_words('lower(query)')}, {sql_list(lex.NEWS_WORDS)}) THEN {lex.NEWS_TTL}
      WHEN list_has_any({sql_words('lower(query)')}, {sql_list(lex.DOCS_WORDS)}) THEN {lex.DOCS_TTL} ELSE {lex.OTHER_TTL} END AS ttl FROM q""",
    "text_signals": rf"""SELECT doc_id, array_to_string(list_sort({_NUM.format(x='text')}), '|') AS numbers, len(list_filter({_NUM.format(x='text')}, lambda n: n <> '1280')) > 0 AS new_number,
      len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: regexp_matches(w, '^\p{{Lu}}') AND strlen(w) >= 3 AND NOT list_contains({sql_list(lex.FRAMING)}, {sql_alower('w')})
      AND NOT contains('how many of 1,280 licensed', {sql_alower('w')}))) > 0 AS new_name FROM documents""",
}
