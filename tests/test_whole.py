"""Registered queries look at every document, whatever its number."""

import duckdb

from quarry.functions.expr import sql_list
from quarry.plans import q_verify


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def whole(sf):
    """All documents, each dealt to one question."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    p = f"p AS (SELECT doc_id % {q_verify.N} AS query_id, doc_id, text, {sql_list(q_verify.TITLES)}[(doc_id % 5) + 1] AS title FROM documents)"
    return con, f"WITH {q_verify._Q}, {p}"


def test_coverage_of_all_documents(spark, sf):
    con, given = whole(sf)
    want = con.execute(f"{given}, {q_verify._coverage_sql('p')} SELECT q.query_id, round(coalesce(coverage, 1), 6), coalesce(uncovered, '') FROM q LEFT JOIN cov USING (query_id)").fetchall()
    assert rows(q_verify.coverage(spark, sf), "query_id", "coverage", "uncovered") == sorted(want)


def test_presence_in_all_documents(spark, sf):
    con, given = whole(sf)
    want = con.execute(f"{given}, {q_verify._presence_sql('p')} SELECT query_id, shape, presence FROM pre").fetchall()
    assert rows(q_verify.answer_presence(spark, sf), "query_id", "shape", "presence") == sorted(want)


def test_late_documents_decide(spark, tmp_path):
    """Only documents from 960 on, which are 20 and more in their round of 30 or not, have the words of question 0."""
    n, words = q_verify.N, "rugby team players: 15"
    docs = [(i, words if i >= 960 and i % n == 0 else "nothing of it here", "en", "s", 1) for i in range(1_200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["query_id"]: r for r in q_verify.coverage(spark, str(tmp_path)).collect()}
    assert got[0]["coverage"] == 1.0 and got[0]["uncovered"] == ""
    presence = {r["query_id"]: r["presence"] for r in q_verify.answer_presence(spark, str(tmp_path)).collect()}
    assert presence[0] == "present"
    classes = {r["query_id"]: r["failure_class"] for r in q_verify.failure_classes(spark, str(tmp_path)).collect()}
    assert classes[0] is None and classes[7] == "no_hits" and "answer_absent" in classes.values()
