"""From the result lists of providers to the pages worth fetching.

Hits have query_id, query, engine, batch_ord (order in which providers
answered), pos (place in the list), title, url and snippet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import lexicon as lex
from quarry.functions import understand as u
from quarry.functions.expr import alower, strings
from quarry.functions.urls import apex_domain, domain, url_key
from quarry.options import FanoutPolicy


def index_family(engine: Column | str) -> Column:
    e = F.col(engine) if isinstance(engine, str) else engine
    out = e
    for name, family in lex.INDEX_FAMILY.items():
        out = F.when(e == name, F.lit(family)).otherwise(out)
    return out


def is_vertical(engine: Column | str) -> Column:
    return (F.col(engine) if isinstance(engine, str) else engine).isin(lex.VERTICALS)


def hard_block(error: Column | str) -> Column:
    """Whether an error says that the provider shuts us out."""
    return F.rlike(F.col(error) if isinstance(error, str) else error, F.lit("captcha|challenge|403|429|blocked"))


def skip_plan(asked: DataFrame, health: DataFrame | None = None, searxng_url: str | None = None) -> DataFrame:
    """``asked`` (query_id, query, engine) with ``skip``: unconfigured, gated,
    quarantined (engine in ``health`` with quarantined true), or null."""
    if health is None:
        known = asked.withColumn("_q", F.lit(False))
    else:
        known = asked.join(health.select("engine", F.col("quarantined").alias("_q")), "engine", "left")
    missing = F.lit(not searxng_url) & (F.col("engine") == "searxng")
    reason = F.when(missing, F.lit("unconfigured")).when(~u.takes_part("engine", "query"), F.lit("gated")).when(F.coalesce("_q", F.lit(False)), F.lit("quarantined"))
    return known.withColumn("skip", reason).drop("_q")


def with_quorum(answers: DataFrame, policy: FanoutPolicy = FanoutPolicy()) -> DataFrame:
    """``answers`` (query_id, engine, latency_ms, urls) that arrive in time and
    up to the one that completes the quorum, with their ``arrival``.

    Ties arrive in the order of engine names.  What is new in an answer is
    counted where a key first appears, so sums run over plain numbers.
    """
    timely = answers.where(F.col("latency_ms") < policy.deadline_ms)
    order = Window.partitionBy("query_id").orderBy("latency_ms", "engine")
    timely = timely.withColumn("arrival", F.row_number().over(order))
    each = timely.select("query_id", "arrival", F.explode("urls").alias("url"))

    def fresh(value: Column, name: str) -> DataFrame:
        firsts = each.select("query_id", "arrival", value.alias("_v")).where("_v <> ''").groupBy("query_id", "_v").agg(F.min("arrival").alias("arrival"))
        return firsts.groupBy("query_id", "arrival").agg(F.count("*").alias(name))

    counted = timely.join(fresh(domain("url"), "_d"), ["query_id", "arrival"], "left").join(fresh(url_key("url"), "_k"), ["query_id", "arrival"], "left")
    upto = Window.partitionBy("query_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    done = (total((F.size("urls") > 0).cast("int")) >= policy.min_engines) & (total("_d") >= policy.min_domains) & (total("_k") >= policy.min_hits)
    counted = counted.withColumn("_done", done.cast("int"))
    before = Window.partitionBy("query_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("_over", F.coalesce(F.max("_done").over(before), F.lit(0))).where("_over = 0").drop("_d", "_k", "_done", "_over")


def outcome(metrics: DataFrame) -> DataFrame:
    """query_id, attempted, succeeded, failed_all of rows (query_id, skip, error)."""
    tried = F.col("skip").isNull()
    done = metrics.groupBy("query_id").agg(F.count_if(tried).alias("attempted"), F.count_if(tried & F.col("error").isNull()).alias("succeeded"))
    return done.withColumn("failed_all", (F.col("attempted") > 0) & (F.col("succeeded") == 0))


def firsts(hits: DataFrame) -> DataFrame:
    """The first hit of each URL key of a query, with ``url_key``; ``ord`` is
    (pos, batch_ord), by which they follow one another round by round."""
    keyed = hits.withColumn("url_key", url_key("url"))
    first = Window.partitionBy("query_id", "url_key").orderBy("pos", "batch_ord")
    kept = keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept.withColumn("ord", F.struct("pos", "batch_ord"))


def interleaved(hits: DataFrame) -> DataFrame:
    """The first hit of each URL key, round by round; ``ord`` is its place."""
    return firsts(hits).withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "batch_ord")))


def consensus(hits: DataFrame) -> DataFrame:
    """query_id, url_key that two different indexes or more returned."""
    keyed = hits.select("query_id", url_key("url").alias("url_key"), index_family("engine").alias("family")).distinct()
    return keyed.groupBy("query_id", "url_key").agg(F.count("*").alias("_n")).where("_n >= 2").drop("_n")


def understood(queries: DataFrame) -> DataFrame:
    """``queries`` with what ``candidate_score`` needs of their text, worked out
    before a query is repeated for its hits."""
    return queries.withColumns({"_anchors": u.anchors("query"), "_subjects": u.subject_tokens("query"), "_domains": u.intent_domains("query")})


def with_candidate_score(hits: DataFrame) -> DataFrame:
    """``hits`` (query, url, title, snippet) with ``candidate_score``: how well
    a hit suits its query.  The texts searched have columns, so that they are
    worked out once for a hit and not for each token."""
    own = hits if "_anchors" in hits.columns else understood(hits)
    own = own.withColumns({"_hay": alower(F.concat_ws(" ", "url", "title", "snippet")), "_title": alower("title")})
    hay, title, anchors, subjects, domains = map(F.col, ("_hay", "_title", "_anchors", "_subjects", "_domains"))
    has = lambda h, t: F.contains(h, t)
    add = lambda xs, f: F.aggregate(F.transform(xs, f), F.lit(0), lambda a, x: a + x)
    metric = lambda s: F.array_contains(strings(lex.METRIC_WORDS), s)
    per_anchor = add(anchors, lambda a: F.when(has(title, a), F.lit(6)).when(has(hay, a), F.lit(3)).otherwise(F.lit(0)))
    per_subject = add(subjects, lambda s: F.when(~has(hay, s), F.lit(0)).when(metric(s), F.lit(1)).when(has(title, s), F.lit(4)).otherwise(F.lit(2)))
    in_title = F.size(F.filter(subjects, lambda s: has(hay, s) & has(title, s)))
    score = (
        F.when((F.size(subjects) > 0) & u.head_stub("url", "title"), F.lit(-20)).otherwise(F.lit(0))
        + per_anchor
        + per_subject
        + F.when(in_title >= 2, F.lit(4)).otherwise(F.lit(0))
        + F.when(F.exists(domains, lambda d: has(hay, d)), F.lit(1)).otherwise(F.lit(0))
        - F.when(u.discussion_intent("query") & F.contains("url", F.lit("wikipedia.org")), F.lit(2)).otherwise(F.lit(0))
    )
    known = (F.size(anchors) > 0) | (F.size(subjects) > 0) | (F.size(domains) > 0)
    return own.withColumn("candidate_score", F.when(known, score).otherwise(F.lit(0))).drop("_hay", "_title", "_anchors", "_subjects", "_domains")


def ordered(hits: DataFrame, most: int) -> DataFrame:
    """At most ``most`` hits of each query (with ``ord``) in the order to fetch,
    ``fetch_ord`` from 1: the best first; of a larger pool one of each site
    first, then a second one, and no more."""
    best = (F.desc("candidate_score"), "ord")
    site = Window.partitionBy("query_id", "_site").orderBy(*best)
    own = Window.partitionBy("query_id")
    # Tasks keep ``most + 1`` of a site and then of a query before rows move: enough to tell whether the pool is larger, and for the result in either case.
    scored = with_candidate_score(hits).withColumn("_site", apex_domain("url"))
    few = scored.withColumn("_turn", F.row_number().over(site)).where(F.col("_turn") <= most + 1)
    few = few.withColumn("_r", F.row_number().over(own.orderBy("_turn", *best))).where(F.col("_r") <= most + 1)
    sited = few.withColumn("_turn", F.when(F.count("*").over(own) <= most, F.lit(1)).otherwise(F.col("_turn"))).where("_turn <= 2")
    return sited.withColumn("fetch_ord", F.row_number().over(own.orderBy("_turn", *best))).where(F.col("fetch_ord") <= most).drop("_r", "_site", "_turn")
