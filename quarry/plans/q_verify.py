"""Queries of verdicts, over the sample questions and passages of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexicon as lex
from quarry.functions.expr import sql_alower, sql_list, sql_string
from quarry.operators import ranking
from quarry.operators import verification as v
from quarry.plans.q_text import SAMPLE, SQL_SHAPES, sql_anchors, sql_distinct, sql_subjects

#: Titles that some passages have, to meet the questions' words.
TITLES = ["Rust HTML libraries", "The capital of Australia: Canberra", "Berlin Wall, 1989", "gold 79", ""]
N = len(SAMPLE)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(i, q) for i, q in enumerate(SAMPLE)], "query_id long, query string"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document n is a passage of question n % N: every document of one question."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    title = F.get(F.array(*map(F.lit, TITLES)), (F.col("doc_id") % 5).cast("int"))
    return docs.select((F.col("doc_id") % N).alias("query_id"), F.col("doc_id").alias("page_ord"), F.lit(0).alias("passage_index"), "text", title.alias("source_title"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = v.coverage(queries(spark, sf_dir), passages(spark, sf_dir))
    return found.select("query_id", F.round("coverage", 6).alias("coverage"), F.array_join("uncovered", "|").alias("uncovered"))


def answer_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.answer_presence(queries(spark, sf_dir), passages(spark, sf_dir))


def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are all documents, passages those above the engine's floor (with
    a word of their question); question 7 has no hits."""
    q, p = queries(spark, sf_dir), passages(spark, sf_dir)
    pages = p.select("query_id", "page_ord")
    scored = p.join(q, "query_id").withColumn("score", F.lit(1.0))
    floor = ranking.floored(ranking.penalised(scored)).select(*p.columns)
    out, single = v.drained(q, floor, pages)
    generated = p.groupBy("query_id").agg(F.count("*").alias("generated"))
    return v.failure_class(q, out, pages, v.answer_presence(q, out).select("query_id", "presence"), single, generated, q.where("query_id <> 7"))


_Q = f"q AS (SELECT query_id::BIGINT AS query_id, query FROM (VALUES {', '.join(f'({i}, {sql_string(x)})' for i, x in enumerate(SAMPLE))}) AS t(query_id, query))"
_P = f"p AS (SELECT doc_id % {N} AS query_id, doc_id, text, {sql_list(TITLES)}[(doc_id % 5) + 1] AS title FROM documents)"


def _coverage_sql(source: str) -> str:
    return f"""tk0 AS (SELECT query_id, {sql_subjects('query')} AS x FROM q), tk AS (SELECT query_id, {sql_distinct('x')} AS tokens FROM tk0),
ex AS (SELECT query_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM tk),
hit AS (SELECT ex.query_id, token, pos, bool_or(contains({sql_alower("title || ' ' || text")}, token)) AS h FROM ex JOIN {source} AS s ON s.query_id = ex.query_id GROUP BY ex.query_id, token, pos),
cov AS (SELECT query_id, avg(h::INT) AS coverage, coalesce(string_agg(token, '|' ORDER BY pos) FILTER (NOT h), '') AS uncovered, count(*) FILTER (NOT h) AS n_uncovered FROM hit GROUP BY query_id)"""


def _presence_sql(source: str) -> str:
    num = "list_transform(regexp_extract_all({x}, '[0-9]+(?:[,.:/][0-9]+)*'), lambda r: regexp_replace(r, '[^0-9]', '', 'g'))"
    name = rf"""len(list_filter(regexp_extract_all(title || ' ' || text, '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: regexp_matches(w, '^\p{{Lu}}') AND strlen(w) >= 3 AND NOT list_contains({sql_list(lex.FRAMING)}, {sql_alower('w')})
      AND NOT contains({sql_alower('query')}, {sql_alower('w')}))) > 0"""
    number = f"len(list_filter({num.format(x=chr(40) + 'title || chr(32) || text' + chr(41))}, lambda n: NOT list_contains({num.format(x='query')}, n))) > 0"
    return f"""{SQL_SHAPES}, car AS (SELECT s.query_id, bool_or(CASE WHEN shape IN ('numeric', 'year') THEN {number} WHEN shape = 'entity' THEN {name} END) AS carried FROM s JOIN {source} AS x ON x.query_id = s.query_id GROUP BY s.query_id),
pre AS (SELECT s.query_id, shape, CASE WHEN shape = 'not_value_seeking' THEN 'not_applicable' WHEN carried THEN 'present' ELSE 'absent' END AS presence FROM s LEFT JOIN car USING (query_id))"""


QUERIES = {"coverage": coverage, "answer_presence": answer_presence, "failure_classes": failure_classes}
ORACLES = {
    "coverage": f"WITH {_Q}, {_P}, {_coverage_sql('p')} SELECT q.query_id, round(coalesce(coverage, 1), 6) AS coverage, coalesce(uncovered, '') AS uncovered FROM q LEFT JOIN cov USING (query_id)",
    "answer_presence": f"WITH {_Q}, {_P}, {_presence_sql('p')} SELECT query_id, shape, presence FROM pre",
    "failure_classes": f"""WITH {_Q}, {_P}, a AS (SELECT query_id, CASE WHEN len({sql_anchors('query')}) > 0 THEN {sql_anchors('query')} ELSE {sql_subjects('query')} END AS needed FROM q),
      fl AS (SELECT p.* FROM p JOIN a USING (query_id) WHERE len(needed) = 0 OR list_bool_or(list_transform(needed, lambda t: contains({sql_alower("title || ' ' || text")}, t)))), {_coverage_sql('fl')},
      o1 AS (SELECT fl.* FROM fl LEFT JOIN cov USING (query_id) WHERE coalesce(n_uncovered, 0) < 2), pgs AS (SELECT query_id, count(*) AS n FROM p GROUP BY query_id),
      th AS (SELECT q.query_id, count(o.doc_id) = 1 AND coalesce(max(pgs.n), 0) = 1 AS thin FROM q LEFT JOIN o1 o USING (query_id) LEFT JOIN pgs USING (query_id) GROUP BY q.query_id),
      o2 AS (SELECT o1.* FROM o1 JOIN th USING (query_id) WHERE NOT thin), {_presence_sql('o2')}
      SELECT q.query_id, CASE WHEN q.query_id = 7 THEN 'no_hits' WHEN (SELECT count(*) FROM o2 WHERE o2.query_id = q.query_id) > 0 THEN NULL WHEN th.thin THEN 'thin_evidence' WHEN presence = 'absent' THEN 'answer_absent'
        WHEN coalesce(pgs.n, 0) = 0 THEN 'fetch_starved' ELSE 'low_score_floor' END AS failure_class
      FROM q LEFT JOIN th USING (query_id) LEFT JOIN pre USING (query_id) LEFT JOIN pgs USING (query_id)""",
}
