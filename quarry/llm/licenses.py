"""License notices by diagonal voting.

All rolling two-word grams of every text are joined, by hash and then word for
word, to their positions in a fixed set of templates.  A match at word p of the
text and word q of a template votes for the diagonal p - q.  Votes are summed
per diagonal, and neighbouring diagonals (a word left out or put in) are merged to
one span.  A span is verified by the longest chain of its matches that goes forward
in text and template with steps between diagonals of at most GAP; it counts if the
chain has enough of the template's grams and all deciding ones, and
does not lie in the span of a longer template.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.store import documents, id_and_text, let

#: Phrases and labels of the base rule.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Openings of public license texts and notices, their labels,
#: and the grams without which a text is another license.
TEMPLATES = {
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": ("gpl", ("gnu general",)),
    "this work is licensed under the gnu general public license version 3": ("gpl", ("gnu general",)),
    "gnu lesser general public license": ("lgpl", ("gnu lesser", "lesser general")),
    "gnu affero general public license": ("agpl", ("gnu affero", "affero general")),
    "licensed under the apache license version 2 0": ("apache", ("apache license",)),
    "you may not use this file except in compliance with the license": ("apache", ("this file", "the license")),
    "cc by nc": ("cc-by-nc", ("cc by", "by nc")),
    "cc by nd": ("cc-by-nd", ("cc by", "by nd")),
    "cc by sa": ("cc-by-sa", ("cc by", "by sa")),
    "cc by nc nd": ("cc-by-nc-nd", ("cc by", "by nc", "nc nd")),
    "cc by nc sa": ("cc-by-nc-sa", ("cc by", "by nc", "nc sa")),
    "this work is licensed under a creative commons attribution 4 0 international license": ("cc-by", ("creative commons", "commons attribution", "attribution 4")),
    "released under the mit license": ("mit", ("mit license",)),
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": ("mit", ("free of",)),
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": ("isc", ("without fee",)),
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": ("bsd", ("binary forms",)),
    "this source code form is subject to the terms of the mozilla public license v 2 0": ("mpl", ("mozilla public",)),
    "this is free and unencumbered software released into the public domain": ("unlicense", ("public domain",)),
    "all rights reserved": ("proprietary", ("all rights", "rights reserved")),
}
GAP, MIN_SHARE, MIN_VOTES = 3, 0.75, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _NOT_WORD), "")


def _positions(spark: SparkSession, templates: list[tuple[str, str, tuple[str, ...], bool]]) -> DataFrame:
    rows = [("", -1, 0, 1, 1, 0, "", False)]  # met by every text once
    for t, (phrase, label, deciding, base) in enumerate(templates):
        words = phrase.split()
        grams = [" ".join(words[q : q + 2]) for q in range(len(words) - 1)]
        needed = sum(1 << q for q, g in enumerate(grams) if g in deciding)
        rows += [(g, t, q, 1 << q, len(grams), needed, label, base) for q, g in enumerate(grams)]
    return spark.createDataFrame(rows, "t_gram string, template int, q int, bit long, n_grams int, needed long, label string, base boolean")


def _gram_hash(first: Column, second: Column) -> Column:
    return F.xxhash64(first, second)


def _hits(words: Column, grams: list[str], hashes: list[int]) -> Column:
    """(p, gram) of the word pairs that some template has, and one pair ""."""
    marker = F.array(F.struct(F.lit(0).alias("p"), F.lit("").alias("gram")))

    def met(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.struct(i.alias("p"), _gram_hash(F.get(w, i), F.get(w, i + 1)).alias("h")))
        known = F.filter(pairs, lambda g: g["h"].isin(hashes))
        return F.transform(known, lambda g: F.struct(g["p"].alias("p"), F.concat_ws(" ", F.get(w, g["p"]), F.get(w, g["p"] + 1)).alias("gram")))

    return let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.concat(marker, F.when(F.size(w) >= 2, met(w)).otherwise(F.array().cast("array<struct<p:int,gram:string>>"))).alias("g")))


def best_chain(diagonals: list[tuple[int, int]], gap: int = GAP) -> tuple[int, int, int]:
    """(matched positions of the template as bits, first word, last word) of
    the longest chain of matches; ``diagonals``: (diagonal, bits of its matched
    positions).  Along a chain template positions and words go up, and from one
    match to the next the diagonal changes by at most ``gap``."""
    held = {d: [q for q in range(bits.bit_length()) if bits >> q & 1] for d, bits in diagonals}
    chains: dict[int, list[tuple[int, int, int, int, int]]] = {d: [] for d in held}  # q, length, bits, first word, last word
    best = (0, 0, 0, 0)
    for q in sorted({q for qs in held.values() for q in qs}):
        new = []
        for d, qs in held.items():
            if q not in qs:
                continue
            own = (1, 1 << q, q + d, q + d + 1)
            for e in range(d - gap, d + gap + 1):
                for last_q, length, bits, first, _ in chains.get(e, ()):
                    if last_q + e < q + d and (length + 1, -first) > (own[0], -own[2]):
                        own = (length + 1, bits | 1 << q, first, q + d + 1)
            new.append((d, own))
        for d, own in new:
            chains[d].append((q, *own))
            if (own[0], -own[2]) > (best[0], -best[2]):
                best = own
    return best[1], best[2], best[3]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, end, share, found = [], [], [], []
        for base, n, needed, diagonals in zip(*(batch.column(k).to_pylist() for k in ("base", "n_grams", "needed", "diagonals"))):
            bits, first, last = best_chain([(x["diagonal"], x["hit"]) for x in diagonals])
            share.append(bits.bit_count() / n)
            start.append(first)
            end.append(last)
            found.append(base or (share[-1] >= MIN_SHARE and bits & needed == needed))
        columns = [batch.column(k) for k in _KEY]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(share, pa.float64()), pa.array(found, pa.bool_())], names=[*_KEY, "start", "end", "share", "found"])


_KEY = ["_row", "doc_id", "n_words", "template", "label", "base"]


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, tuple[str, tuple[str, ...]]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(spans, summary) of every row.

    spans: _row, doc_id, n_words, template, label, base, start, end, share, found for each
    span, from word ``start`` to word ``end``, with the ``share`` of the template's grams
    that it has, and whether it counts (template -1: a row for each text).  summary: doc_id, n_words,
    n_base, first_word, last_word, base_labels, labels, score.  Null and empty
    texts have no words; repeated rows and null ids get a row each; of chains of one length
    the first counts; an empty table gives an empty table; other columns are not
    read; texts are whole, in work linear in their words.  Templates have 2 to 60 words.
    """
    known = [(p, label, (), True) for p, label in base.items()] + [(p, *rest, False) for p, rest in templates.items()]
    positions = _positions(docs.sparkSession, known)
    pairs = sorted({g for (g,) in positions.select("t_gram").collect() if g})  # fixed: some 200
    hashes = [r[0] for r in docs.sparkSession.createDataFrame([tuple(g.split()) for g in pairs], "a string, b string").select(_gram_hash(F.col("a"), F.col("b"))).collect()]
    rows = id_and_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("_row"), "doc_id", _hits(words_of(F.col("text")), pairs, hashes).alias("_w"))
    exploded = rows.select("_row", "doc_id", F.col("_w.n").alias("n_words"), F.explode("_w.g").alias("g")).select("_row", "doc_id", "n_words", "g.p", "g.gram")
    hits = exploded.join(F.broadcast(positions), F.col("gram") == F.col("t_gram"))
    key = [*_KEY, "n_grams", "needed"]
    votes = hits.groupBy(*key, (F.col("p") - F.col("q")).cast("long").alias("diagonal")).agg(F.count("*").alias("votes"), F.bit_or("bit").alias("hit"))
    votes = votes.where((F.col("votes") >= F.least(F.lit(MIN_VOTES), F.col("n_grams"))) & (~F.col("base") | (F.col("votes") == F.col("n_grams"))))
    order = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.col("base") | (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(GAP + 1)) > GAP)
    spans = votes.withColumn("_span", F.sum(apart.cast("int")).over(order))
    spans = spans.groupBy(*key, "_span").agg(F.collect_list(F.struct("diagonal", "hit")).alias("diagonals")).drop("_span")
    spans = spans.mapInArrow(_verified, "_row long, doc_id long, n_words long, template int, label string, base boolean, start long, end long, share double, found boolean")
    # A span within that of a longer template says less than that.
    here = F.struct((F.col("end") - F.col("start")).alias("words"), "start", "end")
    spans = spans.withColumn("_longest", F.collect_set(F.when(F.col("found") & ~F.col("base") & (F.col("template") >= 0), here)).over(Window.partitionBy("_row")))
    inside = F.exists("_longest", lambda x: (x["start"] <= F.col("start")) & (x["end"] >= F.col("end")) & (x["words"] > F.col("end") - F.col("start")))
    spans = spans.withColumn("found", F.col("found") & (F.col("base") | ~inside)).drop("_longest")
    is_base, counts = F.col("base"), (F.col("template") >= 0) & F.col("found")
    named = lambda when: F.array_join(F.sort_array(F.collect_set(F.when(when, F.col("label")))), ",")
    summary = spans.groupBy("_row", "doc_id", "n_words").agg(
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).alias("last_word"),
        named(is_base).alias("base_labels"),
        named(counts).alias("labels"),
        F.coalesce(F.max(F.when(F.col("template") >= 0, F.col("share"))), F.lit(0.0)).alias("score"),
    )
    return spans, summary.drop("_row")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))[1]


QUERIES = {"op3_licenses": op3_licenses}
ORACLES: dict[str, str] = {}
