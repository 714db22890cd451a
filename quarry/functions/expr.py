"""Column helpers shared by the operators, and their DuckDB spellings."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space as Unicode defines it, spelt out for engines whose \s is ASCII.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def alower(c: Column | str) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(col(c), _UPPER, _LOWER)


def words(c: Column | str) -> Column:
    """Runs of anything but Unicode white space."""
    return F.array_remove(F.split(col(c), f"[{SPACES}]+"), "")


def trim_ws(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^[{SPACES}]+|[{SPACES}]+$", "")


def core(c: Column | str) -> Column:
    """Without what is neither letter nor number at both ends."""
    return F.regexp_replace(col(c), r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", "")


def strings(values: Iterable[str]) -> Column:
    """A literal array."""
    return F.array(*[F.lit(v) for v in values])


def contains_any(c: Column | str, values: Iterable[str]) -> Column:
    """Whether one of the values is a substring."""
    out = F.lit(False)
    for v in values:
        out = out | F.contains(col(c), F.lit(v))
    return out


def in_list(c: Column | str, values: Iterable[str]) -> Column:
    return col(c).isin(list(values))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once for a row: an expression
    that a lambda mentions would be worked out again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# The same for DuckDB.


def sql_string(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: Iterable[str]) -> str:
    return "[" + ", ".join(map(sql_string, values)) + "]"


def sql_alower(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{SPACES}]+'), lambda z: z <> '')"


def sql_core(x: str) -> str:
    return rf"regexp_replace({x}, '^[^\p{{L}}\p{{M}}\p{{N}}]+|[^\p{{L}}\p{{M}}\p{{N}}]+$', '', 'g')"


def sql_contains_any(x: str, values: Iterable[str]) -> str:
    return f"list_bool_or(list_transform({sql_list(values)}, lambda m: contains({x}, m)))"
