"""Quality rules whose thresholds adapt to each language and source.

Five measures of every whole text come from DataFrame functions alone.
Mergeable quantile sketches (one pass, grouping sets of language and source,
language, and everything) give each group its own fences: a ratio may lie
``reach`` times the distance from the median to the nearer quartile from the
median, and at least ``slack``, so that junk on one side moves no fence out
before it is half of a group.  A group's fence lies at most ``slack`` beyond
its language's.  A group with fewer than
``min_group`` rows takes its language's fences, a small language the corpus's.
The fences are joined back to the rows and the verdict is read off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.store import documents, let, row_of, written

BLANK = r"[ \t\n\x0B\f\r]"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: ratio: (least distance of a fence from its quantile, whether low values count too)
RATIOS = {"chars_per_word": (2.0, True), "symbols_per_word": (0.15, False), "dup_line_share": (0.25, False), "repeat_share": (0.10, False)}
QUARTILES = (0.25, 0.50, 0.75)
REACH, MIN_GROUP, ACCURACY = 4.0, 200, 10_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(hashes: Column, width: int) -> Column:
    """Words in windows whose hash occurs twice or more among ``hashes``."""

    def twice(s: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda e, k: F.when(k > 0, same(e, k - 1)).otherwise(False) | same(e, k + 1)), lambda e: e["i"]))

    def union(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.when(k > 0, F.least(F.lit(width), x - F.get(p, F.greatest(k - 1, F.lit(0))))).otherwise(F.lit(width)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, twice), union)


def _measured(rows: DataFrame) -> DataFrame:
    """``rows`` with the measures and n_lines of their text; a null text has no words.

    Windows are compared by 64-bit hashes within one text only.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.col("words")
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return (
        rows.withColumn("words", F.array_remove(F.split(text, f"{BLANK}+"), ""))
        .withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")))
        .withColumn("windows", F.when(F.size(words) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
        .withColumns(
            {
                "n_words": F.size(words).cast("long"),
                "word_chars": F.length(F.array_join(words, "")).cast("long"),
                "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
                "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
                "n_lines": F.size("lines").cast("long"),
                "n_repeat_words": F.when(F.size("windows") == F.size(F.array_distinct("windows")), F.lit(0)).otherwise(_covered(F.col("windows"), WINDOW)).cast("long"),
            }
        )
        .drop("words", "lines", "windows")
    )


def _rows(docs: DataFrame, text_col: str, carried: Column | None, **others: Column) -> DataFrame:
    """The text and what is carried along, under this module's own names."""
    columns = [docs[f"`{text_col}`"].cast("string").alias("text"), *[c.alias(n) for n, c in others.items()]]
    return docs.select(*columns, *([] if carried is None else [carried.alias("row")]))


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measures, which replace columns of their names."""
    others = [c for c in docs.columns if c not in MEASURES]
    return _measured(_rows(docs, text_col, row_of(docs, MEASURES))).select(*[F.col(f"row.`{c}`").alias(c) for c in others], *MEASURES)


def _ratio(name: str) -> Column:
    over = {"chars_per_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words")}[name]
    return F.try_divide(F.col(over[0]).cast("double"), F.col(over[1]).cast("double"))


def _fences_of(quartiles: Column, slack: float) -> tuple[Column, Column]:
    below, mid, above = (F.get(quartiles, F.lit(k)) for k in range(3))
    reach = F.greatest(F.lit(slack), REACH * F.least(mid - below, above - mid))
    return mid - reach, mid + reach


def fences(measured: DataFrame) -> DataFrame:
    """_lang, _source and the fences of each ratio (low_*, high_*) for every
    language and source met, nulls among them."""
    rows = measured.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[_ratio(r).alias(r) for r in RATIOS])
    sketches = rows.groupingSets([["_lang", "_source"], ["_lang"], []], "_lang", "_source").agg(
        F.grouping_id().alias("_level"), F.count("*").alias("_rows"), *[F.percentile_approx(r, list(QUARTILES), ACCURACY).alias(r) for r in RATIOS]
    )
    sketches = written(sketches, "sketches")
    names = list(RATIOS)
    own = sketches.where("_level = 0").select("_lang", "_source", F.col("_rows").alias("_rows0"), *[F.col(r).alias(f"{r}0") for r in names])
    lang = sketches.where("_level = 1").select(F.col("_lang").alias("_lang1"), F.col("_rows").alias("_rows1"), *[F.col(r).alias(f"{r}1") for r in names])
    every = sketches.where("_level = 3").first()  # one row, or none for an empty table
    both = own.join(lang, F.col("_lang").eqNullSafe(F.col("_lang1")))
    for r in names:
        whole = every[r] if every and every[r] else [None] * 3
        both = both.withColumn(f"{r}3", F.array(*[F.lit(x).cast("double") for x in whole]))
    out: list[Column] = [F.col("_lang"), F.col("_source")]
    for r, (slack, low_too) in RATIOS.items():
        of_lang = F.when(F.col("_rows1") >= MIN_GROUP, F.col(f"{r}1")).otherwise(F.col(f"{r}3"))
        (low, high), (lang_low, lang_high) = (_fences_of(q, slack) for q in (F.when(F.col("_rows0") >= MIN_GROUP, F.col(f"{r}0")).otherwise(of_lang), of_lang))
        out.append(F.least(high, lang_high + slack).alias(f"high_{r}"))
        if low_too:
            out.append(F.greatest(low, lang_low - slack).alias(f"low_{r}"))
    return both.select(*out)


def _judged(docs: DataFrame, carried: Column | None, lang_col: str, source_col: str, text_col: str, most_groups: int) -> DataFrame:
    """row (what is carried), the measures, base_failed and kept of every row."""
    rows = _rows(docs, text_col, carried, lang=docs[f"`{lang_col}`"], source=docs[f"`{source_col}`"])
    measured = written(_measured(rows).drop("text"), "measured")
    limits = written(fences(measured), "fences")
    if limits.count() <= most_groups:
        limits = F.broadcast(limits)
    joined = measured.join(limits, measured["lang"].eqNullSafe(limits["_lang"]) & measured["source"].eqNullSafe(limits["_source"]), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    inside = F.lit(True)
    for r, (_, low_too) in RATIOS.items():
        inside &= F.coalesce(_ratio(r) <= F.col(f"high_{r}"), F.lit(True))
        if low_too:
            inside &= F.coalesce(_ratio(r) >= F.col(f"low_{r}"), F.lit(True))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & inside)


def verdicts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", most_groups: int = 100_000, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed and kept, which replace columns of these names.

    A null or empty text fails the base rules; a null language or source is a
    group like any other; repeated rows get the same verdict; values on a fence
    are inside; an empty table gives an empty table; other columns, whatever their
    names, stay as they are; texts of any length are measured whole.  The table of fences is broadcast only if it has at
    most ``most_groups`` rows.  Without ``keep_text`` the text is left out.
    """
    new = (*MEASURES, "base_failed", "kept")
    gone = new if keep_text else (*new, text_col)
    others = [c for c in docs.columns if c not in gone]
    judged = _judged(docs, row_of(docs, gone) if others else None, lang_col, source_col, text_col, most_groups)
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in others], *new)


def kept_documents(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", most_groups: int = 100_000) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all its columns as they
    are, those named like a measure or ``kept`` too; otherwise as ``verdicts``."""
    judged = _judged(docs, row_of(docs), lang_col, source_col, text_col, most_groups).where("kept")
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    return verdicts(docs, keep_text=False).select("doc_id", *MEASURES, "base_failed", "kept")


QUERIES = {"op5_quality": op5_quality}

_QUANTILES = ", ".join(f"list_extract(list_sort(list({r}) FILTER ({r} IS NOT NULL)), greatest(1, ceil({q} * count({r})))::BIGINT) AS {r}_{k}" for r in RATIOS for k, q in enumerate(QUARTILES))


def _fence_sql(r: str) -> str:
    slack, low_too = RATIOS[r]

    def fences_of(own: bool) -> tuple[str, str]:
        first = f"WHEN o.g_rows >= {MIN_GROUP} THEN o.{r}_{{k}} " if own else ""
        below, mid, above = (f"(CASE {first.format(k=k)}WHEN l.g_rows >= {MIN_GROUP} THEN l.{r}_{k} ELSE e.{r}_{k} END)" for k in range(3))
        reach = f"greatest({slack}, {REACH} * least({mid} - {below}, {above} - {mid}))"
        return f"({mid} - {reach})", f"({mid} + {reach})"

    (low, high), (lang_low, lang_high) = fences_of(True), fences_of(False)
    out = f"coalesce(m.{r} <= least({high}, {lang_high} + {slack}), true)"
    return out + (f" AND coalesce(m.{r} >= greatest({low}, {lang_low} - {slack}), true)" if low_too else "")


ORACLES = {
    "op5_quality": rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + {WINDOW - 1}] AS g FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS t(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m0 AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
              length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
              (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
       FROM d JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
m AS (SELECT *, word_chars::DOUBLE / nullif(n_words, 0) AS chars_per_word, n_symbols::DOUBLE / nullif(n_words, 0) AS symbols_per_word,
             n_dup_lines::DOUBLE / nullif(n_lines, 0) AS dup_line_share, n_repeat_words::DOUBLE / nullif(n_words, 0) AS repeat_share,
             n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m0),
o AS (SELECT lang, source, count(*) AS g_rows, {_QUANTILES} FROM m GROUP BY lang, source),
l AS (SELECT lang, count(*) AS g_rows, {_QUANTILES} FROM m GROUP BY lang),
e AS (SELECT {_QUANTILES} FROM m)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(map(_fence_sql, RATIOS))} AS kept
FROM m JOIN o ON m.lang IS NOT DISTINCT FROM o.lang AND m.source IS NOT DISTINCT FROM o.source
JOIN l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN e"""
}
