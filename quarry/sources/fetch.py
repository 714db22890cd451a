"""Pages fetched by a given transport, one row for each URL whatever happens.

A transport asks one address and follows no redirect; every hop's host is
resolved and vetted here before it is asked, so that no redirect leads inside.
"""

from __future__ import annotations

import ipaddress
import socket
import time
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.options import InvalidUrl, SsrfBlocked, TooManyRedirects
from quarry.operators.egress import MAX_HOPS, address_is_public, decoded_body, target

#: What a transport returns for a URL: (final URL, status, body, content type);
#: for a redirect (status 300 to 399) the final URL is where it leads to.
Transport = Callable[[str], tuple[str, int, bytes, str | None]]
#: The addresses of a host.
Resolver = Callable[[str], list[str]]
_NAMES = ["url", "fetch_ord", "final_url", "status", "body", "content_type", "error", "total_fetch_ms"]
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.int64()]


def system_resolver(host: str) -> list[str]:
    return sorted({info[4][0] for info in socket.getaddrinfo(host, None)})


def literal_resolver(host: str) -> list[str]:
    """Addresses as they are written; local names are those of this machine.
    Other names are left to the transport, which must vet what they resolve to."""
    try:
        return [str(ipaddress.ip_address(host.strip("[]")))]
    except ValueError:
        return ["127.0.0.1"] if host == "localhost" or host.endswith(".localhost") else ["8.8.8.8"]


def plain_transport(timeout_ms: int, max_bytes: int) -> Transport:
    """One request over the standard library, no redirect followed, at most
    ``max_bytes`` read."""

    def get(url: str) -> tuple[str, int, bytes, str | None]:
        import http.client

        parts = urlsplit(url)
        kind = http.client.HTTPSConnection if parts.scheme.lower() == "https" else http.client.HTTPConnection
        link = kind(parts.hostname, parts.port, timeout=timeout_ms / 1000)
        try:
            link.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"Accept": "text/html,application/json;q=0.9,*/*;q=0.5"})
            answer = link.getresponse()
            return answer.getheader("Location") or url, answer.status, answer.read(max_bytes), answer.getheader("Content-Type")
        finally:
            link.close()

    return get


def vetted_get(url: str, get: Transport, resolve: Resolver, max_hops: int = MAX_HOPS) -> tuple[str, int, bytes, str | None]:
    """What ``url`` answers in the end; raises what forbids or fails a hop."""
    for _ in range(max_hops + 1):
        parts = urlsplit(url.strip())
        if parts.scheme.lower() not in ("http", "https") or not parts.hostname:
            raise InvalidUrl(f"no http(s) address: {url}")
        try:
            found = [str(ipaddress.ip_address(parts.hostname))]  # no resolver has a say in these
        except ValueError:
            found = resolve(parts.hostname)
        if not found or not all(map(address_is_public, found)):
            raise SsrfBlocked(f"blocked address: {parts.hostname}")
        final, status, body, kind = get(url)
        if not 300 <= status <= 399:
            return final, status, body, kind
        url = urljoin(url, final)
    raise TooManyRedirects(f"more than {max_hops} redirects")


def fetched(urls: DataFrame, get: Transport, concurrency: int = 3, max_bytes: int = 512_000, resolve: Resolver = literal_resolver) -> DataFrame:
    """``urls`` (url, fetch_ord) with final_url, status, body (text), bytes_read,
    content_type, error and total_fetch_ms, from ``concurrency`` tasks.

    A URL that is no http(s) address is not asked for, nor a hop whose host has
    an address that is not public (by ``resolve``; give ``system_resolver`` for
    names); an error of the
    transport becomes the row's error; longer bodies are cut; order by
    fetch_ord to have the order of the input.
    """

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, order, error in zip(*(batch.column(k).to_pylist() for k in range(3))):
                began, got = time.monotonic(), (None, None, None, None)
                if error is None:
                    try:
                        got = vetted_get(url, get, resolve)
                        error = None if 200 <= got[1] < 300 else f"status {got[1]}"
                    except Exception as e:  # noqa: BLE001  an error of one page is a row of its own
                        error = f"{type(e).__name__}: {e}"
                final, status, body, kind = got
                rows.append((url, order, final, status, (body or b"")[:max_bytes], kind, error, int(1000 * (time.monotonic() - began))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(_NAMES), _KINDS)], names=_NAMES)

    vetted = urls.select("url", F.col("fetch_ord").cast("long").alias("fetch_ord"), target("url")["error"].alias("error")).repartition(concurrency)
    schema = "url string, fetch_ord long, final_url string, status int, body binary, content_type string, error string, total_fetch_ms long"
    out = vetted.mapInArrow(asked, schema)
    return out.withColumn("bytes_read", F.octet_length("body").cast("long")).withColumn("body", decoded_body("body", "content_type", max_bytes))
