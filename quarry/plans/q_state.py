"""Queries of provider health, over events, and of fan-out planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexicon as lex
from quarry.functions.expr import sql_list, sql_string
from quarry.operators import candidates as c
from quarry.operators import health as h
from quarry.options import FanoutPolicy
from quarry.plans.q_pages import SQL_HITS, hits
from quarry.plans.q_text import SAMPLE, _phrase_sql

NOW = "2024-01-30 00:00:00"
ERRORS = ["HTTP 403 Forbidden", "captcha page", "timed out", "status 429", "request blocked", "dns failure", "Challenge", "challenge found"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are failures (hard blocks if the value is above 400), anything
    else a success whose value is its latency; user n asked provider n % 15."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    engine = F.get(F.array(*map(F.lit, lex.PROVIDERS)), (F.col("user_id") % 15).cast("int"))
    return e.select("event_id", "ts", engine.alias("engine"), (F.col("event_type") != "error").alias("success"), ((F.col("event_type") == "error") & (F.col("value") > 400)).alias("hard_block"), F.col("value").alias("latency_ms"))


def _written(c: str) -> Column:
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def quarantine_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.timeline(events(spark, sf_dir)).select("event_id", "engine", F.col("failures").cast("long").alias("failures"), _written("quarantined_until").alias("until"))


def ewma_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.latency(events(spark, sf_dir)).select("engine", F.round("ewma_ms", 4).alias("ewma_ms"))


def health_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = h.snapshot(events(spark, sf_dir), F.lit(NOW).cast("timestamp").cast("timestamp"))
    return s.select("engine", F.col("consecutive_failures").cast("long").alias("consecutive_failures"), _written("quarantined_until").alias("until"), "total_successes", "total_failures", F.round("ewma_ms", 4).alias("ewma_ms"))


def hard_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, e) for i, e in enumerate(ERRORS)], "error_id int, error string").select("error_id", c.hard_block("error").alias("hard"))


def skip_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All providers for the sample questions; those with an odd number of
    failures in events are quarantined."""
    asked = spark.createDataFrame([(i, q, p) for i, q in enumerate(SAMPLE) for p in lex.PROVIDERS], "query_id long, query string, engine string")
    bad = events(spark, sf_dir).groupBy("engine").agg((F.count_if(~F.col("success")) % 2 == 1).alias("quarantined"))
    return c.skip_plan(asked, bad).select("query_id", "engine", "skip")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = hits(spark, sf_dir).groupBy("query_id", "engine", "batch_ord").agg(F.collect_list("url").alias("urls"))
    return lists.withColumn("latency_ms", (F.col("batch_ord") * 313 + F.col("query_id") * 71) % 1300)


def quorum_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = c.with_quorum(answers(spark, sf_dir), FanoutPolicy(min_engines=2, min_domains=3, min_hits=12))
    return kept.select("query_id", "engine", F.col("arrival").cast("long").alias("arrival"), F.size("urls").cast("long").alias("n_urls"))


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in lex.PROVIDERS], "engine string").select("engine", c.index_family("engine").alias("family"), c.is_vertical("engine").alias("vertical"))


_EVENTS = f"""e AS (SELECT event_id, ts, {sql_list(lex.PROVIDERS)}[(user_id % 15) + 1] AS engine, event_type <> 'error' AS success, event_type = 'error' AND value > 400 AS hard, value AS latency_ms FROM events)"""
_TIMELINE = f"""{_EVENTS}, i AS (SELECT *, sum(success::INT) OVER (PARTITION BY engine ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e),
s AS (SELECT *, sum((NOT success)::INT) OVER (PARTITION BY engine, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM i),
q AS (SELECT *, CASE WHEN NOT success AND (hard OR failures >= 3) THEN ts + INTERVAL 600 SECONDS END AS until0 FROM s),
t AS (SELECT *, last_value(until0 IGNORE NULLS) OVER (PARTITION BY engine, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS until_ts FROM q)"""
_EWMA = """w AS (SELECT engine, latency_ms, row_number() OVER (PARTITION BY engine ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY engine) AS n FROM e WHERE success),
l AS (SELECT engine, round(sum(0.2 * pow(0.8, r - 1) * latency_ms) + max(pow(0.8, n)) * 500, 4) AS ewma_ms FROM w GROUP BY engine)"""
_VALUES = ", ".join(f"({i}, {sql_string(q)}, {sql_string(p)})" for i, q in enumerate(SAMPLE) for p in lex.PROVIDERS)
_GATED = "CASE engine " + " ".join(f"WHEN '{v}' THEN {_phrase_sql(lex.GATES[v])}" for v in lex.VERTICALS) + " ELSE true END"

QUERIES = {
    "quarantine_timeline": quarantine_timeline, "ewma_latency": ewma_latency, "health_snapshot": health_snapshot, "hard_blocks": hard_blocks, "skip_plan": skip_plan,
    "quorum_cutoff": quorum_cutoff, "index_families": families,
}
ORACLES = {
    "quarantine_timeline": f"WITH {_TIMELINE} SELECT event_id, engine, failures::BIGINT AS failures, strftime(until_ts, '%Y-%m-%d %H:%M:%S.%f') AS until FROM t",
    "ewma_latency": f"WITH {_EVENTS}, {_EWMA} SELECT engine, ewma_ms FROM l",
    "health_snapshot": f"""WITH {_TIMELINE}, {_EWMA}, z AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY engine ORDER BY ts DESC, event_id DESC) = 1),
      g AS (SELECT engine, count(*) FILTER (success) AS total_successes, count(*) FILTER (NOT success) AS total_failures FROM e GROUP BY engine)
      SELECT z.engine, failures::BIGINT AS consecutive_failures, strftime(until_ts, '%Y-%m-%d %H:%M:%S.%f') AS until, total_successes, total_failures, coalesce(ewma_ms, 500) AS ewma_ms FROM z JOIN g USING (engine) LEFT JOIN l USING (engine)""",
    "hard_blocks": f"SELECT error_id, regexp_matches(error, 'captcha|challenge|403|429|blocked') AS hard FROM (VALUES {', '.join(f'({i}, {sql_string(x)})' for i, x in enumerate(ERRORS))}) AS t(error_id, error)",
    "skip_plan": f"""WITH {_EVENTS}, b AS (SELECT engine, count(*) FILTER (NOT success) % 2 = 1 AS quarantined FROM e GROUP BY engine), a AS (SELECT query_id::BIGINT AS query_id, query, engine FROM (VALUES {_VALUES}) AS t(query_id, query, engine))
      SELECT query_id, engine, CASE WHEN engine = 'searxng' THEN 'unconfigured' WHEN NOT ({_GATED}) THEN 'gated' WHEN coalesce(quarantined, false) THEN 'quarantined' END AS skip FROM a LEFT JOIN b USING (engine)""",
    "quorum_cutoff": f"""WITH {SQL_HITS}, l AS (SELECT query_id, engine, batch_ord, count(*) AS n_urls, (batch_ord * 313 + query_id * 71) % 1300 AS latency_ms FROM hits GROUP BY query_id, engine, batch_ord),
      t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY latency_ms, engine) AS arrival FROM l WHERE latency_ms < 1200),
      ua AS (SELECT t.query_id, t.arrival, hits.domain, hits.key FROM t JOIN hits USING (query_id, engine)),
      d AS (SELECT query_id, arrival, count(*) AS n FROM (SELECT query_id, domain, min(arrival) AS arrival FROM ua WHERE domain <> '' GROUP BY query_id, domain) GROUP BY query_id, arrival),
      k2 AS (SELECT query_id, arrival, count(*) AS n FROM (SELECT query_id, key, min(arrival) AS arrival FROM ua GROUP BY query_id, key) GROUP BY query_id, arrival),
      x AS (SELECT t.*, sum(1) OVER w >= 2 AND coalesce(sum(d.n) OVER w, 0) >= 3 AND coalesce(sum(k2.n) OVER w, 0) >= 12 AS done FROM t LEFT JOIN d ON d.query_id = t.query_id AND d.arrival = t.arrival
        LEFT JOIN k2 ON k2.query_id = t.query_id AND k2.arrival = t.arrival WINDOW w AS (PARTITION BY t.query_id ORDER BY t.arrival ROWS UNBOUNDED PRECEDING))
      SELECT query_id, engine, arrival, n_urls FROM x QUALIFY coalesce(max(done::INT) OVER (PARTITION BY query_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0""",
    "index_families": f"""SELECT engine, CASE WHEN engine IN ('duckduckgo', 'bing', 'yahoo') THEN 'bing' WHEN engine = 'google_wml' THEN 'google' WHEN engine = 'news_rss' THEN 'news' ELSE engine END AS family,
      list_contains({sql_list(lex.VERTICALS)}, engine) AS vertical FROM (SELECT unnest({sql_list(lex.PROVIDERS)}) AS engine)""",
}
