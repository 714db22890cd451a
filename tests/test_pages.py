import pytest
from pyspark.sql import functions as F

from quarry.functions import dom, urls
from quarry.functions import pages as p
from quarry.operators import candidates as c
from quarry.operators import egress, extraction
from quarry.options import SearchOptions
from quarry.sources import serp


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr("t")).collect()]


def test_title_scan(spark):
    html = ["<TITLE>Big &amp; small\nrest</TITLE>", "<title>open <b>x", "<h1>only</h1>", "<title> </title>", "x" * 70000 + "<title>late</title>", "é" * 40000 + "<title>late</title>"]
    assert column(spark, html, lambda t: p.scan_tag(t, "title")) == ["Big & small", "open", None, None, None, None]
    assert column(spark, html[:3], p.page_title) == ["Big & small", "open", "only"]


def test_dom():
    tree = dom.parse("<div class='a b'><p id=x>one<p>two <a href='/u'>three</a><ul><li>i<li>j</ul></div><div data-type='web'>z</div>")
    assert tree.first("#x").text() == "one" and [n.text() for n in tree.select("div.a > ul li")] == ["i", "j"]
    assert tree.first("div[data-type='web']").text() == "z" and tree.first("p a[href]").attrs["href"] == "/u" and tree.first("form") is None
    assert dom.dom_title("<body><h1>\n</h1><h1>Head</h1>") == "Head"


def test_markdown():
    html = "<head><title>t</title></head><nav>menu</nav><h2>Head</h2><p>see <a href='u'>link</a> <b>bold</b><img src=x></p><ul><li>one</li></ul><script>var x</script><footer>f</footer>"
    text = dom.markdown(html)
    assert "menu" not in text and "var x" not in text and "## Head" in text and "[link](u)" in text and "**bold**" in text and "- one" in text


def test_gates(spark):
    prose = "The quick brown fox jumps over the lazy dog and runs away. " * 20
    code = "function aB(){cD=eF;gH(iJ);kL=mN[oP];}" * 40
    assert column(spark, [prose, code, "", "  "], p.is_code_like) == [False, True, False, False]
    df = spark.createDataFrame([("Access Denied", "x"), ("fine", "please ENABLE JavaScript"), ("fine", "a" * 2000 + "captcha"), (None, "ok")], "t string, m string")
    assert [r[0] for r in df.select(p.is_challenge("t", "m")).collect()] == [True, True, False, False]
    df = spark.createDataFrame([("https://x/?hl=RU", "rust"), ("https://x/?hl=ru", "ржавчина"), ("https://x/?hl=en", "rust")], "u string, q string")
    assert [r[0] for r in df.select(p.other_script("u", "q")).collect()] == [True, False, False]


def test_gated_lets_a_waiting_page_in(spark):
    rows = [(1, "rust", 1, "https://x/?hl=ru", "<title>a</title><p>text one</p>"), (1, "rust", 2, "https://x/b", "<title>Access denied</title>"), (2, "rust", 1, "https://x/?hl=ru", "<p>a b</p>"), (2, "rust", 2, "https://x/c", "<title>c</title><p>c d</p>"), (3, "rust", 1, "https://x/d", "  ")]
    pages = spark.createDataFrame(rows, "query_id long, query string, fetch_ord int, url string, html string")
    got = {(r["query_id"], r["page_ord"], r["url"]) for r in extraction.gated(pages, SearchOptions()).collect()}
    assert got == {(1, 0, "https://x/?hl=ru"), (2, 0, "https://x/c")}


def hits(spark, items, query="Rust ratatui"):
    rows = [(1, query, "bing", 0, i, i + 1, t, u, "") for i, (t, u) in enumerate(items)]
    return spark.createDataFrame(rows, "query_id long, query string, engine string, batch_ord int, pos int, ord int, title string, url string, snippet string")


def test_candidates_of_one_site(spark):
    items = [("t", f"https://same.example.com/{i}") for i in range(8)] + [("t", f"https://other{i}.org/") for i in range(4)]
    got = [r["url"] for r in c.ordered(hits(spark, items, "zzz"), 8).orderBy("fetch_ord").collect()]
    assert len(got) == 6 and sum("same" in u for u in got) == 2
    assert c.ordered(hits(spark, items[:3], "zzz"), 8).count() == 3


def test_candidate_score(spark):
    items = [("Year - Wikipedia", "https://en.wikipedia.org/wiki/year"), ("Ratatui on Rust", "https://docs.rs/ratatui"), ("none", "https://x.org")]
    got = [r["url"] for r in c.ordered(hits(spark, items), 2).orderBy("fetch_ord").collect()]
    assert got[0] == "https://docs.rs/ratatui"


def test_url_keys(spark):
    same = ["https://www.docs.rs/ratatui/index.html", "https://docs.rs/ratatui/", "http://docs.rs/ratatui?utm_source=x"]
    assert set(column(spark, same, urls.url_key)) == {"docs.rs/ratatui"}
    assert column(spark, ["https://a.b.co.uk/x", "https://x.y.z.org", "bad"], urls.apex_domain) == ["b.co.uk", "z.org", ""]


def test_v6(spark):
    ips = {"::1": False, "2001:4860:4860::8888": True, "fe80::1": False, "::ffff:10.0.0.1": False, "::ffff:8.8.8.8": True, "fc00::1": False, "2002::1": False, "2001:db8::1": False, "64:ff9b::1": False, "bad:": False, "8.8.8.8": True, "10.0.0.1": False}
    got = {r["ip"]: r["safe"] for r in egress.with_safety(spark.createDataFrame([(i,) for i in ips], "ip string")).collect()}
    assert got == ips


def test_bodies(spark):
    df = spark.createDataFrame([(b"caf\xe9", "text/html; charset=ISO-8859-1"), ("é".encode() * 3, None), (b"a\xff", 'x; charset="utf-8"')], "b binary, c string")
    assert [r[0] for r in df.select(egress.decoded_body("b", "c", 4)).collect()] == ["café", "éé", "a�"]


def test_fetched(spark):
    from quarry.sources.fetch import fetched

    def get(url):
        if "boom" in url:
            raise TimeoutError("late")
        return url, 404 if "none" in url else 200, b"x" * 20, "text/html"

    urls = spark.createDataFrame([(u, i) for i, u in enumerate(["https://a.org", "ftp://a.org", "https://boom.org", "https://none.org"])], "url string, fetch_ord int")
    got = fetched(urls, get, 2, 10).orderBy("fetch_ord").collect()
    assert [r["error"] for r in got] == [None, "unsupported scheme", "TimeoutError: late", "status 404"] and got[0]["body"] == "x" * 10


SERPS = {
    "duckduckgo_lite": "<table><tr><td><a class='result-link' href='//duckduckgo.com/l/?uddg=https%3A%2F%2Fe.org%2F'>T</a></td></tr><tr><td class='result-snippet'>S</td></tr></table>",
    "duckduckgo": "<div class='result results_links results_links_deep web-result'><h2 class='result__title'><a class='result__a' href='https://e.org/'>T</a></h2><a class='result__url'>e.org</a><a class='result__snippet'>S</a></div>",
    "bing": "<li class='b_algo'><h2><a href='https://e.org/'>T</a></h2><div class='b_caption'><p>S</p></div></li>",
    "yahoo": "<div class='dd algo'><div class='compTitle'><a href='https://r.search.yahoo.com/RU=https%3a%2f%2fe.org%2f/RK=2/'><h3>T</h3></a></div><div class='compText'><p>S</p></div></div>",
    "mojeek": "<ul class='results-standard'><li><a class='ob' href='https://e.org/'>x</a><h2><a>T</a></h2><p class='s'>S</p></li></ul>",
    "google_wml": "<div class='zMzFAb'><a class='fuLhoc' href='/url?q=https://e.org/&sa=U'><span class='CVA68e'>T</span></a><div class='taTFJ'><span class='FrIlee'>S</span></div></div>",
    "brave": "<div class='snippet'><a class='result-header' href='https://e.org/'>T</a><div class='snippet-description'>S</div></div>",
}


@pytest.mark.parametrize("page", sorted(SERPS))
def test_result_pages(spark, page):
    df = spark.createDataFrame([(1, SERPS[page]), (2, ""), (3, None)], "query_id long, payload string")
    assert [(r["query_id"], r["title"], r["url"], r["snippet"]) for r in serp.hits(df, page).collect()] == [(1, "T", "https://e.org/", "S")]


def test_other_layouts(spark):
    yahoo = "<div><div><div class='compTitle'><span><a href='https://e.org/'>T</a></span></div></div><p class='compText'>S</p></div><div><div class='compTitle'><b>none</b></div></div>"
    google = "<div><div><a href='https://e.org/'><span>T</span></a><p>x</p></div><div><table><tr><td>S</td></tr></table></div></div><div><p>x</p><div><table></table></div></div>"
    for page, html in {"yahoo": yahoo, "google_wml": google}.items():
        df = spark.createDataFrame([(1, html)], "query_id long, payload string")
        assert [(r["pos"], r["title"], r["url"], r["snippet"]) for r in serp.hits(df, page).collect()] == [(0, "T", "https://e.org/", "S")]
    labelled = "<div class='dd algo'><h3><a href='https://e.org/' aria-label='L'>T</a></h3></div><div class='compTitle'><a href='https://no.org/'>N</a></div>"
    df = spark.createDataFrame([(1, labelled)], "query_id long, payload string")
    assert [(r["title"], r["url"]) for r in serp.hits(df, "yahoo").collect()] == [("L", "https://e.org/")]


def test_selectors_of_children():
    tree = dom.parse("<div id='x'>t<div><a>1</a></div>t<div><p><a>2</a></p></div></div>").first("#x")
    assert tree.first("> div:nth-child(1) > a").text() == "1" and tree.first("> div:nth-child(2) a").text() == "2" and tree.first("> a") is None


def test_challenges(spark):
    pages = {"duckduckgo_lite": "captcha", "duckduckgo": "<form id='challenge-form'></form>", "mojeek": "<head><title>CAPTCHA</title></head><div class='captcha-wrap'><p>JavaScript is required</p></div>", "google_wml": "/sorry/", "brave": "<div class='captcha'></div>"}
    for page, html in pages.items():
        df = spark.createDataFrame([(1, html)], "query_id long, payload string")
        assert serp.errors(df, page).count() == 1 and serp.hits(df, page).count() == 0


def test_empty_tables(spark):
    none = hits(spark, [("a", "https://a.org")]).limit(0)
    assert c.ordered(c.interleaved(none.drop("ord")), 5).count() == 0 and c.consensus(none).count() == 0
    assert extraction.documents(spark.createDataFrame([], "url string, html string")).count() == 0
    assert F is not None
