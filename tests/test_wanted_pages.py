"""A search works on the pages that it wants, and hits move few at a time."""

import random

from pyspark.sql import functions as F

from quarry.operators import candidates as c
from quarry.operators import extraction
from quarry.plans import search as s


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gates_see_the_wanted_pages_only(spark, monkeypatch):
    urls = [f"https://site{i}.org/{i}" for i in range(40)]
    hits = spark.createDataFrame([(1, "bing", 0, i, f"rust {i}", u, "") for i, u in enumerate(urls)], "query_id long, engine string, batch_ord int, pos int, title string, url string, snippet string")
    fetched = spark.createDataFrame([(u, f"<title>rust</title><p>Rust closures of page {i}</p>", None) for i, u in enumerate(urls)], "url string, body string, error string")
    seen, plain = [], extraction.gated
    monkeypatch.setattr(extraction, "gated", lambda pages, options: seen.append(pages) or plain(pages, options))
    result = s.search(spark.createDataFrame([(1, "rust closures")], "query_id long, query string"), hits, fetched)
    # Filters would move below a join, to all that was fetched.
    assert "Join" not in optimized(seen[0]) and seen[0].count() == 5
    assert result.metrics.select("total_raw_hits", "deduplicated_hits", "candidates", "pages").collect() == [(40, 40, 5, 3)]


def by_hand(rows, most):
    """query_id, pos of the hits to fetch in order, of (query_id, pos, site, score)."""
    out = []
    for q in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1]))
        turns = [(1 if len(own) <= most else 1 + sum(x[2] == r[2] for x in own[:i]), i, r[1]) for i, r in enumerate(own)]
        out += [(q, p) for _, _, p in sorted(t for t in turns if t[0] <= 2)[:most]]
    return out


def test_few_hits_of_a_query_move(spark):
    rng, rows = random.Random(3), []
    for q, (n, sites) in enumerate([(3, 1), (5, 1), (6, 1), (5, 5), (6, 5), (40, 3), (40, 40), (200, 2), (200, 60), (1, 1)]):
        rows += [(q, i, rng.randrange(sites), rng.choice([0, 2, 4])) for i in range(n)]
    # "closures" in the title scores 4, in the address only 2.
    text = {0: ("t", "x"), 2: ("t", "closures"), 4: ("closures", "x")}
    table = [(q, "the closures", "bing", 0, i, text[n][0], f"https://s{site}.org/{text[n][1]}/{i}", "") for q, i, site, n in rows]
    df = spark.createDataFrame(table, "query_id long, query string, engine string, batch_ord int, pos int, title string, url string, snippet string").repartition(4, "url")
    for most in (1, 5):
        got = c.ordered(df.withColumn("ord", F.col("pos")), most)
        assert [tuple(r) for r in got.orderBy("query_id", "fetch_ord").select("query_id", "pos").collect()] == by_hand(rows, most)
        # What is counted by query are the rows that limits of a site and of a query have left.
        assert optimized(got).split("count(1)")[1].count("WindowGroupLimit") == 2
