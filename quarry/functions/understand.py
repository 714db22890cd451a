"""What a query asks for, as expressions over its text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import lexicon as lex
from quarry.functions.expr import alower, col, contains_any, core, strings, words


def subject_tokens(query: Column | str) -> Column:
    """Distinct words of three bytes or more that are no stopwords, in order."""
    clean = F.transform(words(query), lambda w: alower(core(w)))
    return F.array_distinct(F.filter(clean, lambda w: (F.octet_length(w) >= 3) & ~F.array_contains(strings(lex.STOPWORDS), w)))


def anchors(query: Column | str) -> Column:
    """Quoted spans, then words shaped like identifiers, acronyms and names."""
    quoted = F.transform(F.regexp_extract_all(col(query), F.lit('"([^"]*)"'), F.lit(1)), lambda s: alower(F.trim(s)))
    quoted = F.filter(quoted, lambda s: s != "")

    def shaped(t: Column) -> Column:
        long = F.octet_length(t) >= 3
        identifier = F.rlike(t, F.lit("[0-9]")) | (F.rlike(t, F.lit(r"[\-/._+]")) & F.rlike(t, F.lit(r"\p{IsAlphabetic}")))
        acronym = F.rlike(t, F.lit("^[A-Z]{2,}$"))
        name = F.rlike(t, F.lit("^[A-Z]")) & ~F.array_contains(strings(lex.STOPWORDS), alower(t))
        return (long & identifier) | acronym | (long & name)

    tokens = F.filter(F.transform(words(query), lambda w: core(w)), lambda t: (F.octet_length(t) >= 2) & shaped(t))
    return F.array_distinct(F.concat(quoted, F.transform(tokens, lambda t: alower(t))))


def intent_domains(query: Column | str) -> Column:
    q = alower(query)
    empty = F.array().cast("array<string>")
    return F.concat(*[F.when(F.contains(q, F.lit(m)), strings(d)).otherwise(empty) for m, d in lex.INTENT_DOMAINS.items()])


def discussion_intent(query: Column | str) -> Column:
    return contains_any(alower(query), lex.DISCUSSION_WORDS)


def head_stub(url: Column | str, title: Column | str) -> Column:
    u, t = alower(url), alower(title)
    return contains_any(u, lex.HEAD_STUBS) | (t.isin(lex.STUB_TITLES) & contains_any(u, lex.STUB_WIKI_URLS))


def phrase_tokens(text: Column | str) -> Column:
    """Words of letters, digits and plus signs, A-Z in lower case."""
    return F.array_remove(F.split(alower(text), r"[^\p{IsAlphabetic}\p{N}+]+"), "")


def has_any_phrase(query: Column | str, phrases: Iterable[str]) -> Column:
    """Whether a phrase stands in the query word by word; phrases of one sign
    that is no word may stand anywhere."""
    padded = F.concat(F.lit(" "), F.array_join(phrase_tokens(query), " "), F.lit(" "))
    out = F.lit(False)
    for p in phrases:
        out = out | (F.contains(alower(query), F.lit(p)) if len(p) == 1 else F.contains(padded, F.lit(f" {p} ")))
    return out


def takes_part(provider: Column | str, query: Column | str) -> Column:
    """Whether a provider is asked: verticals only if the query is their matter."""
    out = F.lit(True)
    for name in lex.VERTICALS:
        out = F.when(col(provider) == name, has_any_phrase(query, lex.GATES[name])).otherwise(out)
    return out


def answer_shape(query: Column | str) -> Column:
    """numeric, year, entity or not_value_seeking."""
    q = F.trim(alower(query))
    tokens = words(q)
    subjects = F.filter(F.transform(tokens, lambda w: core(w)), lambda t: (F.octet_length(t) >= 3) & ~F.array_contains(strings(lex.FRAMING), t))
    question = F.contains(q, F.lit("?")) | F.coalesce(F.get(tokens, F.lit(0)).isin(lex.FRAMING), F.lit(False))
    return (
        F.when(F.size(subjects) == 0, F.lit("not_value_seeking"))
        .when(contains_any(q, lex.NUMERIC_CUES), F.lit("numeric"))
        .when(contains_any(q, lex.YEAR_CUES), F.lit("year"))
        .when(question & (F.size(anchors(query)) > 0), F.lit("entity"))
        .otherwise(F.lit("not_value_seeking"))
    )


def result_ttl(query: Column | str, time_filter: str = "any") -> Column:
    """Seconds for which a result may be kept."""
    tokens = words(F.lower(col(query)))
    news = F.arrays_overlap(tokens, strings(lex.NEWS_WORDS)) | F.lit(time_filter in ("day", "week"))
    return F.when(news, F.lit(lex.NEWS_TTL)).when(F.arrays_overlap(tokens, strings(lex.DOCS_WORDS)), F.lit(lex.DOCS_TTL)).otherwise(F.lit(lex.OTHER_TTL))


def numbers(text: Column | str) -> Column:
    """Distinct numbers as bare digits: 1,280 and 12:30 are 1280 and 1230."""
    runs = F.regexp_extract_all(col(text), F.lit("([0-9]+(?:[,.:/][0-9]+)*)"), F.lit(1))
    return F.array_distinct(F.transform(runs, lambda r: F.regexp_replace(r, "[^0-9]", "")))


def new_number(text: Column | str, query: Column | str) -> Column:
    return F.size(F.array_except(numbers(text), numbers(query))) > 0


def new_name(text: Column | str, query: Column | str) -> Column:
    """Whether a capitalised word of the text is not in the query."""
    q = alower(query)
    found = F.regexp_extract_all(col(text), F.lit(r"([\p{IsAlphabetic}\p{N}]+)"), F.lit(1))
    return F.exists(
        found,
        lambda w: F.rlike(w, F.lit(r"^\p{IsUppercase}")) & (F.octet_length(w) >= 3) & ~F.array_contains(strings(lex.FRAMING), alower(w)) & ~F.contains(q, alower(w)),
    )


def carries_answer(query: Column | str, shape: Column | str, text: Column | str) -> Column:
    """Whether one text may hold the answer; null if none is asked for."""
    s = col(shape)
    return F.when(s.isin("numeric", "year"), new_number(text, query)).when(s == "entity", new_name(text, query))
