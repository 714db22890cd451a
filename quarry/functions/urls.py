"""URL keys, domains and the unwrapping of redirect links, as expressions.

Hosts are compared in lower case; dot segments are not resolved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.expr import alower, col, let, strings, trim_ws
from quarry.functions.lexicon import SECOND_LEVEL, TRACKING_PARAMS

_WHOLE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(trim_ws(url), _WHOLE, group)


def is_url(url: Column | str) -> Column:
    return F.rlike(trim_ws(col(url)), F.lit(_WHOLE)) & (host(url) != "")


def host(url: Column | str) -> Column:
    """Without user and port, in lower case; '' if there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(_part(col(url), 2), r"^.*@", ""), r":\d*$", ""))


def _bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^(www\.)+", "")


def _kept_pairs(url: Column) -> Column:
    """Query pairs that do not track, in order."""
    pairs = F.split(_part(url, 4), "&")
    key = lambda p: alower(F.element_at(F.split(p, "=", 2), 1))
    return F.filter(pairs, lambda p: ~F.startswith(key(p), F.lit("utm_")) & ~F.array_contains(strings(TRACKING_PARAMS), key(p)))


def _query(url: Column, kept: Column) -> Column:
    return F.when((_part(url, 4) == "") | (F.size(kept) == 0), F.lit("")).otherwise(F.concat(F.lit("?"), F.array_join(kept, "&")))


def canonical_url(url: Column | str) -> Column:
    """Without fragment, tracking parameters and one final slash."""
    u = col(url)
    path = F.when(_part(u, 3) == "", F.lit("/")).otherwise(_part(u, 3))
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    kept = F.filter(_kept_pairs(u), lambda p: p != "")
    built = F.concat(F.lower(_part(u, 1)), F.lit("://"), F.lower(_part(u, 2)), path, _query(u, kept))
    return F.when(is_url(u), built).otherwise(F.lower(trim_ws(u)))


def url_key(url: Column | str) -> Column:
    """Host, path and query by which results of different providers agree."""
    u = col(url)
    path = F.regexp_replace(_part(u, 3), "/+$", "")
    path = F.regexp_replace(F.regexp_replace(path, r"(/index\.html)+$", ""), r"(/index\.htm)+$", "")
    built = F.concat(_bare_host(u), F.lower(path), _query(u, _kept_pairs(u)))
    return F.when(is_url(u), built).otherwise(F.lower(trim_ws(u)))


def domain(url: Column | str) -> Column:
    return F.when(is_url(url), _bare_host(col(url))).otherwise(F.lit(""))


def apex_domain(url: Column | str) -> Column:
    last = lambda labels, k: F.try_element_at(labels, F.lit(-k))
    end = lambda labels, n: F.concat_ws(".", *[last(labels, k) for k in range(n, 0, -1)])
    country = lambda labels: (F.length(last(labels, 1)) == 2) & last(labels, 2).isin(SECOND_LEVEL)
    return let(F.split(domain(url), r"\."), lambda x: F.when(F.size(x) <= 2, F.array_join(x, ".")).when(country(x), end(x, 3)).otherwise(end(x, 2)))


def _form_decode(c: Column) -> Column:
    return F.try_url_decode(c)


def unwrap_uddg(href: Column | str) -> Column:
    """The target of a redirect link with a uddg parameter, else the link."""
    h = trim_ws(col(href))
    value = F.regexp_extract(h, r"[?&]uddg=([^&#]*)", 1)
    return F.when(F.contains(h, F.lit("uddg=")) & (value != ""), F.coalesce(_form_decode(value), h)).otherwise(h)


def unwrap_base64(href: Column | str) -> Column:
    """The target of a click link: its rurl, else its u in URL-safe base64
    after an optional "a1", else the link."""
    h = col(href)
    rurl, u = F.regexp_extract(h, r"[?&]rurl=([^&#]*)", 1), F.regexp_extract(h, r"[?&]u=([^&#]*)", 1)
    packed = F.regexp_replace(_form_decode(u), "^a1", "")
    plain = F.rlike(packed, F.lit(r"^[A-Za-z0-9_\-]+={0,2}$")) & (F.length(F.regexp_replace(packed, "=+$", "")) % 4 != 1)
    bare = F.regexp_replace(F.translate(packed, "-_", "+/"), "=+$", "")
    padded = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), "=")
    opened = F.when(plain, F.try_to_binary(padded, F.lit("base64")))
    decoded = F.when(F.is_valid_utf8(opened.cast("string")), opened.cast("string"))
    target = F.when(rurl != "", _form_decode(rurl)).when(u != "", F.coalesce(decoded, h)).otherwise(h)
    return F.when(F.contains(h, F.lit("/ck/a")) | F.contains(h, F.lit("/cr?")), target).otherwise(h)


def unwrap_ru(href: Column | str) -> Column:
    """The target between /RU= and /RK=, else the link."""
    h = col(href)
    value = F.regexp_extract(h, r"/RU=(.*?)(?:/RK=|/RU=|$)", 1)
    return F.when(F.contains(h, F.lit("/RU=")) & (value != ""), F.coalesce(_form_decode(F.regexp_extract(value, "^([^&=]*)", 1)), h)).otherwise(h)


# Hosts and paths of the provider whose links are wrapped.
_WRAPPING_HOSTS = ["google.com", "www.google.com"]
_INSIDE_PATHS = ["/search", "/wml/search", "/url", "/preferences", "/sorry", "/sorry/"]


def unwrap_url_param(href: Column | str) -> Column:
    """The http(s) target of a link, out of its /url?q= or url= wrapping; null
    for links that stay inside, lead nowhere or hold credentials."""
    h = col(href)
    whole = F.when(F.startswith(h, F.lit("/url?")), F.concat(F.lit("https://www.google.com"), h)).when(F.rlike(h, F.lit("^https?://")), h)
    wrapped = host(whole).isin(_WRAPPING_HOSTS) & (_part(whole, 3) == "/url")
    pair = F.get(F.filter(F.split(_part(whole, 4), "&"), lambda p: F.rlike(p, F.lit("^(q|url)="))), F.lit(0))
    target = F.when(wrapped, _form_decode(F.regexp_replace(pair, "^[^=]*=", ""))).otherwise(whole)
    inside = host(target).isin(_WRAPPING_HOSTS) & _part(target, 3).isin(_INSIDE_PATHS)
    fine = F.rlike(target, F.lit("^https?://")) & is_url(target) & ~F.contains(_part(target, 2), F.lit("@")) & ~inside
    return F.when(fine, target)
