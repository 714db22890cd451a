"""Titles, entities and the quality gates of pages, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import lexicon as lex
from quarry.functions.expr import alower, col, contains_any, trim_ws, words

TITLE_BYTES, GATE_CHARS, CODE_CHARS = 65_536, 2_000, 8_000


def decode_entities(text: Column | str) -> Column:
    out = col(text)
    for entity, plain in lex.ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def strip_tags(text: Column | str) -> Column:
    """Without everything between < and > (or the end), and stray >."""
    return F.replace(F.regexp_replace(col(text), r"<[^>]*(>|$)", ""), F.lit(">"), F.lit(""))


def scan_tag(html: Column | str, tag: str) -> Column:
    """The first line of the text in the first such element within 64 KiB, up
    to the next tag or line if it is not closed; null without one."""
    start = F.try_validate_utf8(F.substring(F.encode(col(html), "utf-8"), 1, TITLE_BYTES).cast("string"))
    head = F.when(F.octet_length(col(html)) <= TITLE_BYTES, col(html)).otherwise(F.coalesce(start, F.left(col(html), F.lit(TITLE_BYTES // 4))))
    closed = F.regexp_extract(head, rf"(?s)^.*?<(?i:{tag})[^>]*>(.*?)</(?i:{tag})>", 1)
    is_closed = F.rlike(head, F.lit(rf"(?s)<(?i:{tag})[^>]*>.*?</(?i:{tag})>"))
    open_ = F.regexp_extract(head, rf"(?s)^.*?<(?i:{tag})[^>]*>([^<\n]*)", 1)
    line = trim_ws(F.element_at(F.split(decode_entities(trim_ws(F.when(is_closed, closed).otherwise(open_))), r"\r?\n", 2), 1))
    return F.nullif(line, F.lit(""))


def page_title(html: Column | str) -> Column:
    return F.coalesce(scan_tag(html, "title"), scan_tag(html, "h1"))


def is_challenge(title: Column | str, text: Column | str) -> Column:
    return contains_any(alower(F.coalesce(col(title), F.lit(""))), lex.CHALLENGE_MARKERS) | contains_any(alower(F.left(col(text), F.lit(GATE_CHARS))), lex.CHALLENGE_MARKERS)


def is_code_like(text: Column | str) -> Column:
    """Two of: many signs of code, many identifiers, very long lines."""
    sample = F.left(col(text), F.lit(CODE_CHARS))
    n = F.char_length(sample)
    signs = F.regexp_count(sample, F.lit(r"[{};=()\[\]$_]")) / n
    names = (F.regexp_count(sample, F.lit("[a-z][A-Z]")) + F.regexp_count(sample, F.lit("[_.]"))) / F.greatest(F.size(words(sample)), F.lit(1))
    lines = F.greatest(F.size(F.split(F.regexp_replace(sample, "\n$", ""), "\n")), F.lit(1))
    minified = (n / lines > 500) & (signs > 0.08)
    votes = (signs > 0.12).cast("int") + (names > 0.6).cast("int") + minified.cast("int")
    return F.when(trim_ws(sample) == "", F.lit(False)).otherwise(votes >= 2)


def other_script(url: Column | str, query: Column | str) -> Column:
    """An ASCII query and a URL that asks for a language in another script."""
    ascii_ = ~F.rlike(col(query), F.lit(r"[^\x00-\x7F]"))
    return ascii_ & contains_any(alower(url), lex.OTHER_SCRIPT_MARKERS)


def serp_challenge(html: Column | str) -> Column:
    return contains_any(alower(F.left(col(html), F.lit(4_000))), ["anomaly", "captcha", "challenge-form"])


def speakable(markdown: Column | str) -> Column:
    """Without fenced blocks, table rules, link targets, heading and emphasis
    marks; entities decoded."""
    lines = F.split(col(markdown), r"\r?\n")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("fenced"))

    def step(acc: Column, line: Column) -> Column:
        fence = F.startswith(trim_ws(line), F.lit("```"))
        rule = F.rlike(trim_ws(line), F.lit(r"^[|\-: ]*\|[|\-: ]*$"))
        out = F.when(fence | acc["fenced"] | rule, acc["out"]).otherwise(F.concat(acc["out"], F.array(line)))
        return F.struct(out.alias("out"), F.when(fence, ~acc["fenced"]).otherwise(acc["fenced"]).alias("fenced"))

    kept = F.aggregate(lines, start, step, lambda acc: F.array_join(acc["out"], "\n"))
    plain = F.regexp_replace(kept, r"\[([^\]]*)\]\([^)]*\)", "$1")
    each = F.transform(F.split(plain, "\n"), lambda x: F.replace(F.replace(F.regexp_replace(x, "^[# ]+", ""), F.lit("**"), F.lit("")), F.lit("__"), F.lit("")))
    out = decode_entities(trim_ws(F.array_join(each, "\n")))
    # Entities that were encoded twice.
    for entity, sign in (("&amp;apos;", "'"), ("&amp;quot;", '"'), ("&amp;gt;", ">"), ("&amp;lt;", "<"), ("&amp;amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return out
