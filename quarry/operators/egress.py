"""Which addresses a fetch may reach, and where redirects lead."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import lexicon as lex
from quarry.functions.expr import col
from quarry.functions.urls import host, is_url

MAX_HOPS = 5
_V4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def _v4_number(ip: Column) -> Column:
    octets = [F.regexp_extract(ip, _V4, k).cast("bigint") for k in range(1, 5)]
    number = octets[0] * (1 << 24) + octets[1] * (1 << 16) + octets[2] * (1 << 8) + octets[3]
    return F.when(F.rlike(ip, F.lit(_V4)), F.when(F.greatest(*octets) <= 255, number))


def safe_v4(ip: Column | str) -> Column:
    """Whether a dotted address is public; null if it is none."""
    number = _v4_number(col(ip))
    denied = F.lit(False)
    for net in map(ipaddress.ip_network, lex.DENIED_V4):
        denied = denied | number.between(int(net.network_address), int(net.broadcast_address))
    return F.when(number.isNotNull(), ~denied)


def _v6_safe(text: str) -> bool | None:
    try:
        ip = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    inner = ip.ipv4_mapped
    if inner is None and int(ip) >> 32 == 0 and int(ip) > 1:
        inner = ipaddress.IPv4Address(int(ip))
    if inner is not None:
        return not any(inner in net for net in map(ipaddress.ip_network, lex.DENIED_V4))
    return not any(ip in net for net in map(ipaddress.ip_network, lex.DENIED_V6))


def address_is_public(text: str) -> bool:
    """Whether one address (v4 or v6, with or without a zone) may be reached."""
    text = text.split("%", 1)[0]
    if ":" in text:
        return bool(_v6_safe(text))
    try:
        ip = ipaddress.IPv4Address(text)
    except ValueError:
        return False
    return not any(ip in net for net in map(ipaddress.ip_network, lex.DENIED_V4))


def with_safety(addresses: DataFrame, ip_col: str = "ip", out: str = "safe") -> DataFrame:
    """``addresses`` with whether each (v4 or v6) is public; what is no address
    is not safe.  Only v6 addresses need Python."""

    @F.pandas_udf("boolean")
    def safe_v6(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ips in batches:
            yield ips.map(lambda x: _v6_safe(x) if x else None).astype("boolean")

    v6 = addresses.where(F.contains(F.col(ip_col), F.lit(":"))).withColumn(out, F.coalesce(safe_v6(ip_col), F.lit(False)))
    v4 = addresses.where(F.coalesce(~F.contains(F.col(ip_col), F.lit(":")), F.lit(True))).withColumn(out, F.coalesce(safe_v4(ip_col), F.lit(False)))
    return v4.unionByName(v6)


def safe_hosts(resolved: DataFrame, ip_col: str = "ip") -> DataFrame:
    """host, safe: all addresses of the host are public, and there is one."""
    return with_safety(resolved, ip_col).groupBy("host").agg((F.bool_and("safe") & (F.count(ip_col) > 0)).alias("safe"))


def target(url: Column | str) -> Column:
    """struct(host, port, error) of a URL to fetch: http and https only."""
    u = F.trim(col(url))
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    port = F.regexp_extract(u, r"^[^:]+://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    error = F.when(~is_url(u) & ~scheme.isin("http", "https"), F.when(scheme == "", F.lit("invalid url")).otherwise(F.lit("unsupported scheme"))).when(~scheme.isin("http", "https"), F.lit("unsupported scheme")).when(~is_url(u), F.lit("missing host"))
    default = F.when(scheme == "https", F.lit(443)).otherwise(F.lit(80))
    return F.struct(F.when(error.isNull(), host(u)).alias("host"), F.when(error.isNull(), F.when(port != "", port.cast("int")).otherwise(default)).alias("port"), error.alias("error"))


def resolved_location(base: Column | str, location: Column | str) -> Column:
    """An absolute, scheme-relative, rooted or relative Location against its page."""
    b, to = col(base), col(location)
    origin = F.regexp_extract(b, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(b, r"[?#].*$", ""), r"^([^:/?#]+://[^/?#]*(?:/.*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(F.rlike(to, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), to)
        .when(F.startswith(to, F.lit("//")), F.concat(F.regexp_extract(b, "^([^:]+:)", 1), to))
        .when(F.startswith(to, F.lit("/")), F.concat(origin, to))
        .otherwise(F.concat(folder, to))
    )


def followed(urls: DataFrame, responses: DataFrame, hosts: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """``urls`` (url) with final_url, hop_count, status, body and error.

    ``responses`` (url, status, location, body, content_type) hold what each
    address answers, ``hosts`` (host, safe) what names resolve to; every hop is
    vetted before it is taken.  A hop is a join, so there are ``max_hops`` + 1.
    """
    state = urls.select("url", F.col("url").alias("_at"), F.lit(0).alias("hop_count"), F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("_done"))
    answers = responses.select(F.col("url").alias("_u"), F.col("status").alias("_s"), F.col("location").alias("_l"), F.col("body").alias("_b"), F.col("content_type").alias("_c"))
    vetted = hosts.select(F.col("host").alias("_h"), F.col("safe").alias("_safe"))
    for hop in range(max_hops + 1):
        step = state.withColumn("_t", target("_at")).join(vetted, F.col("_t.host") == F.col("_h"), "left").join(answers, F.col("_at") == F.col("_u"), "left")
        redirect = F.col("_s").between(300, 399)
        next_ = resolved_location("_at", "_l")
        error = (
            F.when(F.col("_t.error").isNotNull(), F.col("_t.error"))
            .when(~F.coalesce("_safe", F.lit(False)), F.lit("blocked address"))
            .when(F.col("_u").isNull(), F.lit("no answer"))
            .when(redirect & F.lit(hop + 1 > max_hops), F.lit("too many redirects"))
            .when(redirect & F.col("_l").isNull(), F.lit("redirect without location"))
            .when(redirect & ~F.rlike(next_, F.lit("^https?://")), F.lit("unsupported scheme"))
            .when(~redirect & ~F.col("_s").between(200, 299), F.concat(F.lit("status "), F.col("_s")))
        )
        on = ~F.col("_done")
        moved = {
            "error": F.when(on, error).otherwise(F.col("error")),
            "hop_count": F.when(on, F.lit(hop + 1)).otherwise(F.col("hop_count")),
            "status": F.when(on, F.col("_s")).otherwise(F.col("status")),
            "body": F.when(on & error.isNull() & ~redirect, F.col("_b")).otherwise(F.col("body")),
            "content_type": F.when(on & ~redirect, F.col("_c")).otherwise(F.col("content_type")),
            "_at": F.when(on & error.isNull() & redirect, next_).otherwise(F.col("_at")),
            "_done": F.col("_done") | error.isNotNull() | ~F.coalesce(redirect, F.lit(False)),
        }
        state = step.select("url", *[c.alias(n) for n, c in moved.items()])
    return state.select("url", F.col("_at").alias("final_url"), "hop_count", "status", "body", "content_type", "error")


def charset(content_type: Column | str) -> Column:
    label = F.regexp_extract(F.coalesce(col(content_type), F.lit("")), r"""(?:^|;)\s*charset=["']*([^;"']*)""", 1)
    return F.nullif(F.trim(label), F.lit(""))


def decoded_body(body: Column | str, content_type: Column | str, most: int = 524_288) -> Column:
    """The first ``most`` bytes as text, by the named charset or else UTF-8,
    with broken sequences replaced."""
    head = F.substring(col(body), 1, most)
    label = F.upper(F.coalesce(charset(content_type), F.lit("UTF-8")))
    return F.when(label.isin("ISO-8859-1", "LATIN1", "WINDOWS-1252"), F.decode(head, "ISO-8859-1")).when(label.isin("UTF-16", "UTF-16LE"), F.decode(head, "UTF-16LE")).otherwise(F.make_valid_utf8(head.cast("string")))
