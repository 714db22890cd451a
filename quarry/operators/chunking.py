"""Passages of a text: overlapping windows of words, or packed paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.expr import col, let, trim_ws, words

SIZE, OVERLAP = 150, 30


def _limits(size: int, overlap: int) -> tuple[int, int]:
    size = size or SIZE
    return size, min(OVERLAP, size - 1) if overlap >= size else overlap


def _windows(tokens: Column, size: int, overlap: int) -> Column:
    """One string for each window of the array of words, the last one short."""
    step = max(size - overlap, 1)
    n = F.when(F.size(tokens) <= size, F.lit(1)).otherwise(F.ceil((F.size(tokens) - size) / step).cast("int") + 1)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(tokens, i * step + 1, size), " "))
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(each)


def word_passages(text: Column | str, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    size, overlap = _limits(size, overlap)
    return let(words(text), lambda w: _windows(w, size, overlap))


def paragraph_passages(text: Column | str, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Paragraphs packed up to ``size`` words, each passage starting with the
    tail of the one before; longer paragraphs are cut into windows of words."""
    size, overlap = _limits(size, overlap)
    block = "array<struct<t:string,n:int>>"
    blocks = F.filter(F.transform(F.split(col(text), "\n\n"), lambda b: F.struct(trim_ws(b).alias("t"), F.size(words(b)).alias("n"))), lambda b: b["n"] > 0)
    total = lambda bs: F.aggregate(bs, F.lit(0), lambda a, b: a + b["n"])
    joined = lambda bs: F.array(F.array_join(F.transform(bs, lambda b: b["t"]), "\n\n"))
    none = F.array().cast(block)

    def tail(bs: Column) -> Column:
        """The longest end of at most ``overlap`` words, one paragraph at least."""
        starts = F.filter(F.sequence(F.lit(1), F.size(bs)), lambda j: (j == F.size(bs)) | (total(F.slice(bs, j, F.size(bs))) <= overlap))
        return F.slice(bs, F.array_min(starts), F.size(bs))

    def step(acc: Column, b: Column) -> Column:
        out, cur = acc["out"], acc["cur"]
        flushed = F.when(F.size(cur) > 0, F.concat(out, joined(cur))).otherwise(out)
        full = (F.size(cur) > 0) & (total(cur) + b["n"] > size)
        packed = F.struct(F.when(full, flushed).otherwise(out).alias("out"), F.concat(F.when(full, tail(cur)).otherwise(cur), F.array(b)).alias("cur"))
        long = F.struct(F.concat(flushed, let(words(b["t"]), lambda w: _windows(w, size, overlap))).alias("out"), none.alias("cur"))
        return F.when(b["n"] > size, long).otherwise(packed)

    start = F.struct(F.array().cast("array<string>").alias("out"), none.alias("cur"))
    rest = lambda acc: F.when(F.size(acc["cur"]) > 0, F.concat(acc["out"], joined(acc["cur"]))).otherwise(acc["out"])
    return let(blocks, lambda bs: F.when(F.size(bs) <= 1, word_passages(text, size, overlap)).otherwise(F.aggregate(bs, start, step, rest)))


def passages(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text_col: str = "markdown", paragraphs: bool = True) -> DataFrame:
    """``pages`` with passage_index (from 0 in each page) and text."""
    cut = (paragraph_passages if paragraphs else word_passages)(text_col, size, overlap)
    keep = [c for c in pages.columns if c != text_col]
    return pages.select(*keep, F.posexplode(cut).alias("passage_index", "text"))
