"""Boilerplate lines by their spread over distinct sites.

A HyperLogLog sketch of the sites of each line merges by aggregation, so a line
that every site carries arrives as one small sketch a task.  Lines whose
estimate is near the threshold get exact distinct counts.  A line with a letter or number that is
spread over ``min_sites`` sites or more is kept in its first document (smallest
id) and goes from all others.  A document that would lose all its characters
stays as it is, and so does one that would lose more than ``copy_share`` of them
if another row has the same text, for the de-duplication of documents to judge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.store import documents, let, row_of, written

#: Sites a boilerplate line has, and the share of the threshold around it in
#: which an estimate is replaced by an exact count (the standard error of the
#: sketch is 1.6 %).
MIN_SITES, NEAR, LG_K, COPY_SHARE = 10, 0.2, 12, 0.5
WORD = r"[\p{L}\p{N}]"


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    """Rows of one id and one text are alike in all that follows."""
    text = docs[text_col].cast("string")
    return {"_id": docs[id_col].cast("long"), "_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit("line"), text)}


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    exploded = docs.select(*[c.alias(n) for n, c in _row_key(docs, id_col, text_col).items()], docs[site_col].cast("string").alias("_site"), F.posexplode(F.split(docs[text_col].cast("string"), "\n")).alias("_pos", "_line"))
    return exploded.where(F.col("_line").rlike(WORD)).select("_id", "_t1", "_t2", "_site", "_pos", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit("line"), "_line").alias("_h2"))


def removals(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """_id, _t1, _t2, _bad, _copied: the line numbers (from 0) that go from the
    rows of this id and text, and whether more than one row has the text; rows
    that lose nothing are absent."""
    lines = _lines(docs, id_col, text_col, site_col)
    spread = lines.groupBy("_h1", "_h2").agg(F.hll_sketch_agg("_site", LG_K).alias("_sites"), F.min("_id").alias("_first"))
    spread = spread.withColumn("_n", F.hll_sketch_estimate("_sites"))
    candidates = written(spread.where(F.col("_n") >= min_sites * (1 - NEAR)).select("_h1", "_h2", "_first", "_n"), "spread")
    hits = written(lines.join(candidates, ["_h1", "_h2"]), "hits")
    near = F.col("_n") <= min_sites * (1 + NEAR)
    exact = hits.where(near).groupBy("_h1", "_h2").agg(F.countDistinct("_site").alias("_exact")).where(F.col("_exact") >= min_sites).select("_h1", "_h2")
    boilerplate = hits.where(~near).unionByName(hits.join(exact, ["_h1", "_h2"], "left_semi").where(near).select(*hits.columns))
    gone = boilerplate.where(~F.col("_id").eqNullSafe(F.col("_first")))
    bad = gone.groupBy("_id", "_t1", "_t2").agg(F.collect_set("_pos").alias("_bad"))
    texts = docs.select(*[c.alias(n) for n, c in _row_key(docs, id_col, text_col).items()]).groupBy("_t1", "_t2").agg(F.count("*").alias("_rows"))
    copies = texts.where("_rows > 1").select("_t1", "_t2", F.lit(True).alias("_copied"))
    return bad.join(copies, ["_t1", "_t2"], "left").withColumn("_copied", F.coalesce("_copied", F.lit(False)))


def _without(lines: Column, bad: Column) -> Column:
    """``lines`` but for those numbered in ``bad``: the stretches between them,
    so that the work is linear in the lines."""

    def rest(s: Column) -> Column:
        at = lambda i: F.get(s["bad"], i)
        start = lambda i: F.when(i > 0, at(i - 1) + 1).otherwise(0)
        end = lambda i: F.coalesce(at(i), F.size(s["lines"]))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["bad"])), lambda i: F.slice(s["lines"], start(i) + 1, end(i) - start(i))))

    return let(F.struct(lines.alias("lines"), F.array_sort(bad).alias("bad")), rest)


def without_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, copy_share: float = COPY_SHARE, counts: bool = True, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source"
) -> DataFrame:
    """``docs``, the text without its boilerplate lines, and with ``counts``
    n_lines and n_removed, which replace columns of these names.

    A null text stays null and has 0 lines, an empty one has 1; a null site
    counts for no line; rows without an id lose the lines whose first document
    has one; repeated rows are treated alike; an empty table gives an empty
    table; other columns, whatever their names, stay as they are.  Texts are
    whole, and the work is linear in their lines.  A hot line's rows are spread
    by the join's skew handling.  With a ``copy_share`` of 1 copies lose their
    boilerplate like any other row.
    """
    bad = removals(docs, min_sites, id_col, text_col, site_col)
    new = ("n_lines", "n_removed") if counts else ()
    others = [c for c in docs.columns if c not in (*new, text_col)]
    keys = _row_key(docs, id_col, text_col)
    rows = docs.select(*[c.alias(k) for k, c in keys.items()], docs[f"`{text_col}`"].cast("string").alias("_text"), *([row_of(docs, (*new, text_col)).alias("_row")] if others else []))
    rows = rows.alias("d").join(bad.alias("b"), on=[F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], how="left").select(*(["d._row"] if others else []), "d._text", "b._bad", "b._copied")
    lines = F.split("_text", "\n")
    chars = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))

    def judged(kept: Column) -> Column:
        left, every = chars(kept), chars(lines)
        whole = (left == 0) | (F.col("_copied") & (every - left > copy_share * every))
        return F.when(~whole, F.struct(F.array_join(kept, "\n").alias("text"), F.size(kept).alias("n")))

    rows = rows.withColumn("_new", F.when(F.size("_bad") > 0, let(_without(lines, F.col("_bad")), judged)))
    n = F.coalesce(F.size(lines), F.lit(0))
    kind = docs.schema[text_col].dataType
    text = F.when(F.col("_new").isNull(), F.col("_text")).otherwise(F.col("_new.text")).cast(kind)
    out = [(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns if c not in new]
    if counts:
        out += [n.cast("long").alias("n_lines"), F.when(F.col("_new").isNull(), F.lit(0)).otherwise(n - F.col("_new.n")).cast("long").alias("n_removed")]
    return rows.select(*out)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return without_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES = {
    "op4_line_dedup": rf"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
s AS (SELECT line, min(doc_id) AS first FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT l.*, s.line IS NOT NULL AND l.doc_id <> s.first AS bad FROM l LEFT JOIN s ON l.line = s.line),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad, sum(length(line)) AS chars, coalesce(sum(length(line)) FILTER (NOT bad), 0) AS left_chars,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS left_text FROM m GROUP BY doc_id),
c AS (SELECT text FROM documents GROUP BY text HAVING count(*) > 1),
j AS (SELECT d.doc_id, d.text, g.*, left_chars = 0 OR (c.text IS NOT NULL AND chars - left_chars > {COPY_SHARE} * chars) AS whole
      FROM documents d JOIN g ON d.doc_id = g.doc_id LEFT JOIN c ON d.text = c.text)
SELECT doc_id, n_lines::BIGINT AS n_lines, CASE WHEN whole THEN 0 ELSE n_bad END::BIGINT AS n_removed,
       length(CASE WHEN whole OR n_bad = 0 THEN text ELSE left_text END)::BIGINT AS n_chars_left,
       sha256(CASE WHEN whole OR n_bad = 0 THEN text ELSE left_text END) AS text_sha256
FROM j"""
}
