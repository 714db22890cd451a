"""Verdicts over the passages delivered for a query.

``queries`` has query_id and query; ``passages`` query_id, text, source_title;
``pages`` query_id.  Everything is grouped sums by query, joined to queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import understand as u
from quarry.functions.expr import alower


def coverage(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, coverage (share of subject tokens in any passage; 1 without
    tokens or passages) and uncovered (tokens in none, in order)."""
    asked = queries.select("query_id", u.subject_tokens("query").alias("tokens"))
    found = passages.join(asked, "query_id").select("query_id", F.transform("tokens", lambda t: F.contains(alower(F.concat_ws(" ", "source_title", "text")), t).cast("int")).alias("hit"))
    hits = found.select("query_id", F.posexplode("hit").alias("pos", "h")).groupBy("query_id", "pos").agg(F.max("h").alias("h"))
    hits = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("hits"))
    both = asked.join(hits, "query_id", "left")
    covered = F.size(F.filter("hits", lambda x: x["h"] == 1))
    return both.select(
        "query_id",
        F.when(F.col("hits").isNull(), F.lit(1.0)).otherwise(covered / F.size("tokens")).alias("coverage"),
        F.when(F.col("hits").isNull(), F.array().cast("array<string>")).otherwise(F.filter("tokens", lambda t, i: F.get("hits", i)["h"] == 0)).alias("uncovered"),
    )


def thin(queries: DataFrame, passages: DataFrame, pages: DataFrame) -> DataFrame:
    """query_id, passages, pages and thin: one passage from one page."""
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    both = queries.select("query_id").join(count(passages, "passages"), "query_id", "left").join(count(pages, "pages"), "query_id", "left").fillna(0, ["passages", "pages"])
    return both.withColumn("thin", (F.col("passages") == 1) & (F.col("pages") == 1))


def answer_presence(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, shape and presence: not_applicable, present or absent."""
    shaped = queries.select("query_id", "query", u.answer_shape("query").alias("shape"))
    carried = passages.select("query_id", "text", "source_title").join(shaped, "query_id").groupBy("query_id").agg(F.bool_or(u.carries_answer("query", "shape", F.concat_ws(" ", "source_title", "text"))).alias("carried"))
    verdict = F.when(F.col("shape") == "not_value_seeking", F.lit("not_applicable")).when(F.col("carried"), F.lit("present")).otherwise(F.lit("absent"))
    return shaped.join(carried, "query_id", "left").select("query_id", "shape", verdict.alias("presence"))


def drained(queries: DataFrame, passages: DataFrame, pages: DataFrame, coverage_floor: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(passages that are delivered, query_id with thin): those of queries with
    two or more uncovered tokens go, then those of thin queries."""
    if coverage_floor > 0:
        gone = coverage(queries, passages).where(F.size("uncovered") >= 2).select("query_id")
        passages = passages.join(gone, "query_id", "left_anti")
    single = thin(queries, passages, pages).select("query_id", "thin")
    return passages.join(single.where("thin"), "query_id", "left_anti"), single


def failure_class(queries: DataFrame, passages: DataFrame, pages: DataFrame, verdicts: DataFrame, single: DataFrame, generated: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id and why nothing was delivered (null if something was).

    ``verdicts`` as of answer_presence, ``single`` as of drained, ``generated``
    query_id and generated (passages before the floor), ``hits`` query_id."""
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    all_ = queries.select("query_id").join(count(passages, "_p"), "query_id", "left").join(count(pages, "_g"), "query_id", "left").join(count(hits, "_h"), "query_id", "left")
    all_ = all_.join(verdicts, "query_id", "left").join(single, "query_id", "left").join(generated, "query_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return all_.select(
        "query_id",
        F.when(n("_h") == 0, F.lit("no_hits"))
        .when(n("_p") > 0, F.lit(None).cast("string"))
        .when(F.col("thin"), F.lit("thin_evidence"))
        .when(F.col("presence") == "absent", F.lit("answer_absent"))
        .when(n("_g") == 0, F.lit("fetch_starved"))
        .when(n("generated") > 0, F.lit("low_score_floor"))
        .otherwise(F.lit("fetch_starved"))
        .alias("failure_class"),
    )
