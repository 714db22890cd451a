"""Ranking of passages within their query: BM25, cosine, hybrid, calibration,
penalty, floor and removal of near-duplicates.

Passages have query_id, query, text, source_title, source_url and the columns
of ``ORDER``, by which equal scores are ordered.  Statistics of a query are
grouped sums joined back, one row a query, so that a query over a whole corpus
is as distributed as many small ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import understand as u
from quarry.functions.expr import alower, core, let, words
from quarry.functions.urls import url_key
from quarry.operators.resemblance import named, removed
from quarry.options import InvalidConfiguration, RankingPolicy
from quarry.store import written

K1, B = 1.5, 0.75
ORDER = ("page_ord", "passage_index")
DENSE_WEIGHT, SPARSE_WEIGHT = 0.65, 0.35
PENALTY, BELOW_FLOOR, SAME = 0.3, 0.02, 0.80
#: Bytes of the words by which passages resemble one another.
LEAST_BYTES = 2
#: What a hit of an anchor or a subject token adds to a pre-score.
ANCHOR, SUBJECT = 2.0, 0.5
_EPSILON = 1.1920929e-07


def _joined(df: DataFrame, stats: DataFrame) -> DataFrame:
    return df.join(stats, "query_id")


def with_hay(passages: DataFrame) -> DataFrame:
    """``passages`` with what a search for words needs of their text, worked out
    before a passage is repeated for several queries."""
    tokens = passages.withColumn("_tokens", words(F.lower("text")))
    # Between two blanks each, a word is found by plain string search.
    return tokens.withColumns({"_len": F.size("_tokens"), "_hay": F.concat(F.lit(" "), F.array_join("_tokens", "  "), F.lit(" "))}).drop("_tokens")


def term_counts(passages: DataFrame) -> DataFrame:
    """``passages`` with _asked, _terms (distinct), _len and _tf, all that BM25
    needs of a passage: the rest may be left out before ``scored``."""
    own = passages if "_hay" in passages.columns else with_hay(passages)
    terms = own.withColumn("_asked", words(F.lower("query"))).withColumn("_terms", F.array_distinct("_asked"))
    found = lambda t: ((F.octet_length("_hay") - F.octet_length(F.replace(F.col("_hay"), F.concat(F.lit(" "), t, F.lit(" ")), F.lit("")))) / (F.octet_length(t) + 2)).cast("int")
    return terms.withColumn("_tf", F.transform("_terms", found)).drop("_hay")


def scored(counted: DataFrame, out: str = "sparse_score") -> DataFrame:
    """``counted`` (as of ``term_counts``; it is read twice, so a written table)
    with the BM25 score of each row among the rows of its query."""
    # One pass for all sums of a query: place 0 has the lengths, the others the passages with a term.
    places = F.concat(F.array(F.col("_len").cast("long")), F.transform("_tf", lambda n: (n > 0).cast("long")))
    sums = counted.select("query_id", F.posexplode(places).alias("_pos", "_v")).groupBy("query_id", "_pos").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    stats = sums.groupBy("query_id").agg(F.max("_n").alias("_N"), F.array_sort(F.collect_list(F.struct("_pos", "_s"))).alias("_sums"))
    both = _joined(counted, stats).withColumn("_avg", F.get("_sums", F.lit(0))["_s"] / F.col("_N"))
    norm = K1 * (1 - B + B * F.col("_len") / F.col("_avg"))

    def part(tf: Column, i: Column) -> Column:
        df = F.get("_sums", i + 1)["_s"]
        times = F.size(F.filter("_asked", lambda x: x == F.get("_terms", i)))
        return times * F.ln(1 + (F.col("_N") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + norm)

    score = F.aggregate(F.transform("_tf", part), F.lit(0.0), lambda a, x: a + x)
    return both.withColumn(out, F.when(F.col("_avg") > 0, score).otherwise(F.lit(0.0))).drop("_asked", "_terms", "_len", "_tf", "_N", "_sums", "_avg")


def with_bm25(passages: DataFrame, out: str = "sparse_score") -> DataFrame:
    """``passages`` with their BM25 score among the passages of their query; a
    word that the query repeats counts again."""
    return scored(written(term_counts(passages), "term-counts"), out)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for empty vectors, different lengths and vectors of length zero."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def embedded(df: DataFrame, embed: Callable[[list[str]], list[list[float]]], text_col: str, out: str) -> DataFrame:
    """``df`` with the vectors of a text column, batch by batch; the embedder
    must return as many vectors as texts, none empty and all finite."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = list(embed(texts.tolist()))
            if len(found) != len(texts):
                raise ValueError(f"embedder returned {len(found)} vectors for {len(texts)} texts")
            yield pd.Series([list(map(float, v)) for v in found])

    return with_checked_vectors(df.withColumn(out, vectors(text_col)), out)


def with_checked_vectors(df: DataFrame, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    bad = F.size(v).isin(0, -1) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.withColumn(vector_col, F.when(bad, F.raise_error(F.lit("embedder returned an empty or non-finite vector"))).otherwise(v))


def pre_scored(passages: DataFrame, out: str = "pre_score") -> DataFrame:
    """BM25 plus 2 for each anchor in the text, 1 in the title, and half for
    each subject token in the text."""
    text, title = alower("text"), alower("source_title")
    hits = lambda tokens, hay, w: let(hay, lambda h: F.aggregate(tokens, F.lit(0.0), lambda a, t: a + F.when(F.contains(h, t), F.lit(w)).otherwise(F.lit(0.0))))
    anchors, subjects = u.anchors("query"), u.subject_tokens("query")
    return passages.withColumn(out, F.col("sparse_score") + hits(anchors, text, ANCHOR) + hits(anchors, title, 1.0) + hits(subjects, text, SUBJECT))


def top_for_embedding(passages: DataFrame, policy: RankingPolicy = RankingPolicy()) -> DataFrame:
    """``passages`` (with sparse_score) with ``to_embed``: all of a query, or
    its best by pre-score if there are more than ``rerank_top``."""
    if not policy.two_stage:
        return passages.withColumn("to_embed", F.lit(True))
    best = Window.partitionBy("query_id").orderBy(F.desc("pre_score"), *ORDER)
    top = pre_scored(passages).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= policy.rerank_top)
    keys = top.select("query_id", *ORDER, F.lit(True).alias("to_embed"))
    return passages.join(keys, ["query_id", *ORDER], "left").withColumn("to_embed", F.coalesce("to_embed", F.lit(False)))


def blend(share: Column, dense: Column) -> Column:
    """The hybrid score; ``dense`` is null if a passage is not embedded."""
    near = F.least(F.greatest(dense, F.lit(0.0)), F.lit(1.0))
    return F.when(dense.isNotNull(), DENSE_WEIGHT * near + SPARSE_WEIGHT * share).otherwise(share)


def blended(passages: DataFrame, consensus: DataFrame | None = None, policy: RankingPolicy = RankingPolicy()) -> DataFrame:
    """``passages`` (with sparse_score and dense_score, null if not embedded)
    with their hybrid score; pages that several indexes agree on gain."""
    best = passages.groupBy("query_id").agg(F.max("sparse_score").alias("_max"))
    both = _joined(passages, best)
    score = blend(share_of(F.col("sparse_score"), F.col("_max")), F.col("dense_score"))
    if consensus is not None:
        agreed = consensus.select("query_id", F.col("url_key").alias("_key"), F.lit(True).alias("_agreed"))
        both = both.withColumn("_key", url_key("source_url")).join(agreed, ["query_id", "_key"], "left").drop("_key")
        score = F.when(F.col("_agreed"), score * policy.consensus_multiplier).otherwise(score)
    return both.withColumn("score", score).drop("_max", "_agreed")


def share_of(score: Column, best: Column) -> Column:
    """``score`` as a share of the best of its query, 0 if that is nothing."""
    return F.when(best > _EPSILON, F.least(F.greatest(score, F.lit(0.0)) / best, F.lit(1.0))).otherwise(F.lit(0.0))


def scaled(passages: DataFrame, mode: str) -> DataFrame:
    """``raw_score`` as it was; ``score`` within 0 and 1: BM25 by the best of
    its query, the others cut off."""
    kept = passages.withColumn("raw_score", F.col("score"))
    if mode != "sparse":
        return kept.withColumn("score", F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)))
    best = kept.groupBy("query_id").agg(F.max("score").alias("_max"))
    return _joined(kept, best).withColumn("score", share_of(F.col("score"), F.col("_max"))).drop("_max")


def needed_tokens(query: Column | str = "query") -> Column:
    """The anchors of a query or, if it has none, its subject tokens."""
    return let(u.anchors(query), lambda a: F.when(F.size(a) > 0, a).otherwise(u.subject_tokens(query)))


def lacks_tokens(tokens: Column) -> Column:
    """Whether a passage has none of the tokens that its query needs."""
    hay = alower(F.concat_ws(" ", "source_title", "text"))
    return (F.size(tokens) > 0) & ~let(hay, lambda h: F.exists(tokens, lambda t: F.contains(h, t)))


def penalised(passages: DataFrame, policy: RankingPolicy = RankingPolicy()) -> DataFrame:
    """Passages without any anchor of the query (or, if it has none, any of its
    subject tokens) fall below the floor; ``_lacks`` says so, or ``_needed`` which tokens, if it is known."""
    missing = F.col("_lacks") if "_lacks" in passages.columns else lacks_tokens(F.col("_needed") if "_needed" in passages.columns else needed_tokens())
    lowered = F.col("score") * PENALTY
    if policy.min_score > 0:
        lowered = F.least(lowered, F.lit(max(policy.min_score - BELOW_FLOOR, 0.0)))
    return passages.withColumn("score", F.when(missing, lowered).otherwise(F.col("score")))


def floored(passages: DataFrame, policy: RankingPolicy = RankingPolicy()) -> DataFrame:
    return passages.where(F.col("score") >= policy.min_score) if policy.min_score > 0 else passages


def rank_column(name: str = "rank") -> Column:
    by = [F.desc("score"), *([F.desc("raw_score")]), *ORDER]
    return F.row_number().over(Window.partitionBy("query_id").orderBy(*by)).alias(name)


def compared(word: Column) -> Column:
    """A word as near-duplicates compare it, if it has ``LEAST_BYTES``."""
    return F.lower(core(word))


def in_order() -> Column:
    """The smallest is the best."""
    return F.struct(-F.col("score"), -F.col("raw_score"), *ORDER, "_id").alias("_order")


def without_near_duplicates(passages: DataFrame, threshold: float = SAME) -> DataFrame:
    """In the order of scores, a passage goes if its words resemble those of a
    passage that stays (Jaccard); see ``quarry.operators.resemblance``."""
    tokens = F.array_sort(F.array_distinct(F.filter(F.transform(words("text"), compared), lambda w: F.octet_length(w) >= LEAST_BYTES)))
    own = passages.withColumn("_words", tokens).withColumn("_set", named(F.col("_words"))).withColumn("_id", F.monotonically_increasing_id())
    own = written(own, "passages")
    # Of equal sets only the first can stay; it stands for all.
    firsts = written(own.where(F.col("_set").isNotNull()).groupBy("query_id", "_set").agg(F.min(in_order()).alias("_order")), "firsts")
    kept = firsts.join(removed(firsts, own, threshold), ["query_id", "_set"], "left_anti").select(F.col("_order._id").alias("_id"))
    return own.where(F.col("_set").isNull()).unionByName(own.join(kept, "_id", "left_semi").select(*own.columns)).drop("_id", "_words", "_set")


def calibrated(passages: DataFrame, mode: str, policy: RankingPolicy = RankingPolicy(), threshold: float = SAME) -> DataFrame:
    return without_near_duplicates(floored(penalised(scaled(passages, mode), policy), policy), threshold)


def ranked(
    passages: DataFrame, mode: str = "sparse", embed: Callable[[list[str]], list[list[float]]] | None = None, consensus: DataFrame | None = None, policy: RankingPolicy = RankingPolicy()
) -> DataFrame:
    """Passages with score, raw_score, sparse_score, dense_score and rank."""
    if mode != "sparse" and embed is None:
        raise InvalidConfiguration(f"ranking mode {mode} needs an embedder")
    null = F.lit(None).cast("double")
    if mode == "sparse":
        scored = with_bm25(passages).withColumns({"dense_score": null, "score": F.col("sparse_score")})
    else:
        queries = embedded(passages.select("query_id", "query").distinct(), embed, "query", "_q").select("query_id", "_q")
        if mode == "dense":
            own = embedded(passages, embed, "text", "_v").join(queries, "query_id")
            scored = own.withColumns({"sparse_score": null, "dense_score": cosine("_v", "_q")}).withColumn("score", F.col("dense_score")).drop("_v", "_q")
        else:
            sparse = top_for_embedding(with_bm25(passages), policy)
            top = embedded(sparse.where("to_embed").select("query_id", *ORDER, "text"), embed, "text", "_v").join(queries, "query_id")
            dense = top.select("query_id", *ORDER, cosine("_v", "_q").alias("dense_score"))
            scored = blended(sparse.drop("to_embed").join(dense, ["query_id", *ORDER], "left"), consensus, policy)
    return calibrated(scored, mode, policy).withColumn("rank", rank_column())
