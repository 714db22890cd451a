"""Hits out of result pages in HTML.

A table says where each kind of page keeps its results; one walker reads it over
trees in Arrow batches.  Links are then unwrapped and filtered by expressions.
A payload table has query_id and payload; hits are as in
quarry.sources.payloads; ``errors`` lists pages that are challenges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import inf

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import urls
from quarry.functions.dom import Node, parse
from quarry.functions.pages import serp_challenge

_HIT = "struct<pos:int,title:string,href:string,display_url:string,snippet:string>"
_PAGE = f"error string, hits array<{_HIT}>"
CHALLENGE = "challenge"


@dataclass(frozen=True)
class Layout:
    """Where one kind of page keeps its results, as selectors: ``boxes`` in the
    page, the other parts in a box.

    ``link`` is the box itself if empty; else the first of its selectors counts
    in the box and around it, the others in the box.  A box lies in the nearest
    of five ancestors that has an ``around``.  A title is the link's ``label``
    attribute, else ``title`` in the first of ``title_in`` that has one; without
    any, ``untitled`` says whether the link's text counts ("link"), no title
    ("empty") or the box is no result ("skip").  ``needs`` must be in a box,
    ``unless`` not in the page.  ``nth_snippet`` of the page belong to the
    boxes by their order.
    """

    boxes: str
    link: tuple[str, ...] = ()
    title: str = ""
    title_in: tuple[str, ...] = ("box",)
    untitled: str = "link"
    label: str = ""
    display: str = ""
    snippet: str = ""
    nth_snippet: str = ""
    around: str = ""
    needs: str = ""
    unless: str = ""


# Where the providers' pages keep their results.  Of several
# layouts of a page the first with results counts.
LAYOUTS: dict[str, tuple[Layout, ...]] = {
    "duckduckgo_lite": (Layout("a.result-link", nth_snippet="td.result-snippet"),),
    "duckduckgo": (
        Layout("div.result.results_links.results_links_deep.web-result", ("h2.result__title a.result__a",), display="a.result__url", snippet="a.result__snippet"),
    ),
    "bing": (Layout("li.b_algo", ("h2 a",), display=".b_attribution cite, cite", snippet=".b_caption p"),),
    "yahoo": (
        Layout("div.dd.algo", (".compTitle > a, h3 a",), title="h3", title_in=("link", "box"), label="aria-label", snippet=".compText p, .compText"),
        Layout(
            "div.compTitle", (".compTitle > a, h3 a", "a"), title="h3", title_in=("link", "box", "around"), label="aria-label",
            snippet=".compText p, .compText", around=".compText p, .compText", unless="div.dd.algo",
        ),
    ),
    "mojeek": (Layout("ul.results-standard > li", ("a.ob",), title="h2 a", untitled="empty", snippet="p.s"),),
    "google_wml": (
        Layout("div.zMzFAb", ("a.fuLhoc[href]",), title="span.CVA68e", title_in=("link",), untitled="skip", snippet="div.taTFJ span.FrIlee"),
        Layout("div", ("> div:nth-child(1) > a[href]",), title="span", title_in=("link",), untitled="skip", snippet="> div:nth-child(2)", needs="> div:nth-child(2) table"),
    ),
    "brave": (
        Layout(
            "div.snippet, div[data-type='web'], div[data-type='search'], div.result", ("a.result-header, a.snippet-title, h2 a, a[href]",),
            title=".snippet-title, h2, a.result-header", display=".snippet-url, cite, .result-header cite",
            snippet=".snippet-description, .snippet-content, p.snippet-description, div.snippet-description",
        ),
    ),
}

# Signs of a page that asks for proof of a person.  Each selector
# must find an element whose text has the pattern.
_ASKS: dict[str, list[tuple[str, str]]] = {
    "duckduckgo": [("form#challenge-form, form[action*='anomaly.js'], .anomaly-modal", "")],
    "mojeek": [("head > title", r"^\s*captcha\s*$"), (".captcha-wrap > p", "javascript is required")],
    "brave": [("form#challenge-form, .cf-browser-verification, div.captcha, #cf-challenge-running", "")],
}
# Such signs in the source, with the size in bytes below which they count.
_ASKS_IN_SOURCE: dict[str, list[tuple[str, float]]] = {
    "google_wml": [('id="captcha-form"', inf), ("id='captcha-form'", inf), ("consent.google.", inf), ("Your browser isn't supported any more", inf), ("/sorry/", 4000)],
}
#: How many ancestors of a box are looked at.
_CLIMB = 5
#: Pages whose snippet is all elements that the selector finds.
_MANY = {"google_wml"}


def _found(places: list[Node], selector: str) -> Node | None:
    return next((n for place in places if (n := place.first(selector)) is not None), None)


def _surroundings(box: Node, selector: str) -> Node:
    """The nearest ancestor below the root that has ``selector``, else the farthest looked at."""
    up = []
    while len(up) < _CLIMB and (at := (up or [box])[-1].parent) is not None and at.parent is not None:
        up.append(at)
    return next((n for n in up if n.first(selector)), (up or [box])[-1])


def _result(box: Node, layout: Layout, joined: bool) -> dict | None:
    if layout.needs and box.first(layout.needs) is None:
        return None
    wide = _surroundings(box, layout.around) if layout.around else box
    link = box if not layout.link else _found([box, wide], layout.link[0])
    for selector in layout.link[1:]:
        link = link if link is not None else box.first(selector)
    if link is None:
        return None
    places = {"link": link, "box": box, "around": wide}
    heading = _found([places[x] for x in layout.title_in], layout.title) if layout.title else None
    if heading is None and layout.untitled == "skip":
        return None
    title = link.attrs.get(layout.label) or (heading.text() if heading is not None else "") or (link.text() if layout.untitled == "link" else "")
    text = lambda selector: " ".join(n.text() for n in wide.select(selector)[: None if joined else 1]) if selector else ""
    return {"title": title.strip(), "href": link.attrs.get("href", "").strip(), "display_url": text(layout.display).strip(), "snippet": text(layout.snippet).strip()}


def _results(tree: Node, page: str) -> list[dict]:
    for layout in LAYOUTS[page]:
        if layout.unless and tree.first(layout.unless) is not None:
            continue
        rows = [_result(box, layout, page in _MANY) for box in tree.select(layout.boxes)]
        if layout.nth_snippet:
            for row, snippet in zip(rows, tree.select(layout.nth_snippet)):
                row["snippet"] = snippet.text()
        if rows := [row for row in rows if row is not None]:
            return [{"pos": i, **row} for i, row in enumerate(rows)]
    return []


def _asks(tree: Node, html: str, page: str) -> bool:
    if any(sign in html and len(html.encode()) < most for sign, most in _ASKS_IN_SOURCE.get(page, [])):
        return True
    signs = _ASKS.get(page, [])
    return bool(signs) and all(any(re.search(pattern, "".join(n.texts()), re.I) for n in tree.select(selector)) for selector, pattern in signs)


def _walked(payloads: DataFrame, page: str) -> DataFrame:
    def read(html: str) -> tuple[str | None, list[dict]]:
        tree = parse(html)
        return (CHALLENGE, []) if _asks(tree, html, page) else (None, _results(tree, page))

    @F.pandas_udf(_PAGE)
    def walked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for payload in batches:
            yield pd.DataFrame([read(x or "") for x in payload], columns=["error", "hits"])

    out = payloads.withColumn("_p", walked("payload")).select(*payloads.columns, "_p.error", "_p.hits")
    if page == "duckduckgo_lite":
        out = out.withColumn("error", F.when(serp_challenge("payload"), F.lit(CHALLENGE)).otherwise(F.col("error")))
    return out


def errors(payloads: DataFrame, page: str) -> DataFrame:
    """query_id, error of pages that ask for proof of a person."""
    return _walked(payloads, page).where("error IS NOT NULL").select("query_id", "error")


def hits(payloads: DataFrame, page: str) -> DataFrame:
    """The hits of result pages of one kind (a key of ``LAYOUTS``)."""
    raw = _walked(payloads, page).where("error IS NULL").select("query_id", F.explode("hits").alias("h")).select("query_id", "h.*")
    unwrap = {"duckduckgo_lite": urls.unwrap_uddg, "duckduckgo": urls.unwrap_uddg, "bing": urls.unwrap_base64, "yahoo": urls.unwrap_ru, "google_wml": urls.unwrap_url_param}.get(page)
    out = raw.withColumn("url", unwrap("href") if unwrap else F.trim("href"))
    keep = F.col("url").isNotNull() & (F.col("url") != "")
    if page == "duckduckgo_lite":
        keep = F.startswith("url", F.lit("http"))
    elif page == "brave":
        keep = F.rlike("url", F.lit("^https?://")) & urls.is_url("url") & (F.col("title") != "")
    elif page == "google_wml":
        keep = keep & (F.col("title") != "")
    out = out.where(keep)
    if page == "google_wml":
        first = out.groupBy("query_id", "url").agg(F.min("pos").alias("pos"))
        out = out.join(first, ["query_id", "url", "pos"], "left_semi")
    if page in ("yahoo", "mojeek", "google_wml"):
        out = out.withColumn("display_url", urls.host("url"))
    engine = "duckduckgo" if page == "duckduckgo_lite" else page
    return out.select("query_id", "pos", "title", F.trim("url").alias("url"), "display_url", "snippet", F.lit(engine).alias("engine"))


def duckduckgo(lite: DataFrame, full: DataFrame) -> DataFrame:
    """The lite page's hits; the full page's for queries where it has none."""
    first = hits(lite, "duckduckgo_lite")
    return first.unionByName(hits(full, "duckduckgo").join(first.select("query_id").distinct(), "query_id", "left_anti"))
