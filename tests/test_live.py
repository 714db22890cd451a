"""A built engine asks its providers, vets every hop, and remembers who fails."""

import json

import pytest

import quarry
from quarry.options import EngineError

PAGE = "<html><head><title>Gold price</title></head><body><article><h1>Gold price</h1><p>" + "The gold price is 2350 dollars per ounce today, say dealers of gold. " * 8 + "</p></article></body></html>"
WIKI = json.dumps({"pages": [{"key": f"Gold_{i}", "title": f"Gold price {i}", "excerpt": "price of gold"} for i in range(4)]})
BING = "<ol>" + "".join(f'<li class="b_algo"><h2><a href="https://site{i}.org/gold">Gold price {i}</a></h2><div class="b_caption"><p>the gold price</p></div></li>' for i in range(6)) + "</ol>"


def network():
    """The three functions by value: executors do not have this module."""
    page, wiki, bing = PAGE, WIKI, BING

    def transport(url):
        if "wikipedia.org/w/rest.php" in url:
            return url, 200, wiki.encode(), "application/json"
        if "bing.com" in url:
            return url, 200, bing.encode(), "text/html"
        if "yahoo.com" in url:
            raise TimeoutError("late")
        if "site1.org" in url:
            return "http://169.254.169.254/meta", 302, b"", None
        if "site2.org/gold" in url:
            return "/moved", 301, b"", None
        return url, 200, page.encode(), "text/html; charset=utf-8"

    def resolve(host):
        return ["10.0.0.7"] if host == "site3.org" else [host] if host[0].isdigit() else ["93.184.216.34"]

    def blocked(url):
        return url, 429, b"", None

    return transport, resolve, blocked


transport, resolve, blocked = network()


def engine(spark, get=transport, providers=("bing", "wikipedia", "yahoo")):
    return quarry.EngineBuilder(spark).with_providers(list(providers)).with_transport(get, resolve).build()


def test_search(spark):
    own = engine(spark)
    result = own.search("gold price", quarry.SearchOptions(max_candidates=4, fanout_deadline_ms=60_000))
    state = {r["engine"]: r for r in result.providers.collect()}
    assert state["bing"]["hits"] == 6 and state["wikipedia"]["hits"] == 4 and state["yahoo"]["error"].startswith("TimeoutError")
    pages = [r["url"] for r in result.pages.collect()]
    assert pages and not any("site1" in u or "site3" in u for u in pages)
    passages = result.passages.collect()
    assert passages and "gold price" in passages[0]["text"].lower()
    metrics = result.metrics.first()
    assert metrics["total_raw_hits"] == 10 and metrics["failure_class"] is None and result.timings["total_ms"] >= result.timings["pages_ms"]
    assert own.search(" Gold price ", quarry.SearchOptions(max_candidates=4, fanout_deadline_ms=60_000)) is result


def test_all_fail_and_are_quarantined(spark):
    own = engine(spark, blocked)
    with pytest.raises(quarry.AllProvidersFailed) as e:
        own.search("gold price")
    assert e.value.attempted == 3 and len(e.value.metrics) == 3
    assert {r["engine"]: r["quarantined"] for r in own._run.health().collect()} == dict.fromkeys(own.providers, True)
    result = own.search("silver price")  # nobody is asked
    assert {r["skip"] for r in result.providers.collect()} == {"quarantined"} and result.metrics.first()["failure_class"] == "no_hits"


def test_fetch_page(spark):
    own = engine(spark)
    page = own.fetch_page("https://site2.org/gold")
    assert page["title"] == "Gold price" and page["final_url"].endswith("/moved") and "2350" in page["markdown"]
    for url in ("https://site1.org/", "https://site3.org/", "http://127.0.0.1/", "http://[::1]/", "ftp://site5.org/"):
        with pytest.raises(EngineError):
            own.fetch_page(url)


def test_embedder_reaches_the_ranking(spark):
    own = quarry.EngineBuilder(spark).with_providers(["bing"]).with_transport(transport, resolve).with_embedder(lambda texts: [[1.0, float(len(t) % 7)] for t in texts]).build()
    result = own.search("gold price", quarry.SearchOptions(ranking_mode="hybrid", fanout_deadline_ms=60_000))
    assert result.metrics.first()["ranking_mode"] == "hybrid"
    assert all(r["dense_score"] is not None for r in result.passages.collect())
