import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.operators import health, verification
from quarry.options import InvalidConfiguration, SearchOptions
from quarry.plans.session import Coalescer, EngineBuilder, ResultCache, cache_key, result_ttl
from quarry.streaming.health import tracked

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, engine string, ts timestamp, success boolean, hard_block boolean, latency_ms double"


def events(marks):
    """s: success of 200 ms, f: failure, h: hard block; one a second."""
    return [(i, "bing", T0 + timedelta(seconds=i), m == "s", m == "h", 200.0) for i, m in enumerate(marks)]


def naive(rows):
    ewma, streak, until = 500.0, 0, None
    for _, _, ts, ok, hard, lat in rows:
        if ok:
            ewma, streak, until = 0.8 * ewma + 0.2 * lat, 0, None
        else:
            streak += 1
            if hard or streak >= 3:
                until = ts + timedelta(seconds=600)
    return round(ewma, 6), streak, until


@pytest.mark.parametrize("marks", ["s", "fff", "ffsff", "hf", "sshs", "ffffs", "fffh", "sfsfsfff"])
def test_snapshot(spark, marks):
    rows = events(marks)
    got = health.snapshot(spark.createDataFrame(rows, SCHEMA), F.lit(T0 + timedelta(seconds=60))).first()
    ewma, streak, until = naive(rows)
    assert (round(got["ewma_ms"], 6), got["consecutive_failures"], got["quarantined_until"]) == (ewma, streak, until)
    assert got["quarantined"] == (until is not None)


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = events("sfsfffsshf")
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(2):
        df.where(f"event_id % 10 {'<' if k == 0 else '>='} 5").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = tracked(stream).writeStream.outputMode("update").format("memory").queryName("health_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    final = spark.table("health_out").collect()[-1]
    ewma, streak, until = naive(rows)
    assert (round(final["ewma_ms"], 6), final["consecutive_failures"]) == (ewma, streak) and final["total_successes"] == 4


def test_thin_and_failure_classes(spark):
    q = spark.createDataFrame([(i, "what is the capital of Australia") for i in range(4)], "query_id long, query string")
    one = spark.createDataFrame([(0, 0, 0, "capital Australia Canberra", ""), (1, 0, 0, "capital Australia", ""), (1, 0, 1, "capital Australia Canberra", "")], "query_id long, page_ord int, passage_index int, text string, source_title string")
    pages = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "query_id long, page_ord int")
    out, single = verification.drained(q, one, pages)
    assert sorted(r["query_id"] for r in out.collect()) == [1, 1]
    gen = spark.createDataFrame([(2, 4)], "query_id long, generated int")
    verdicts = verification.answer_presence(q, out)
    got = {r["query_id"]: r["failure_class"] for r in verification.failure_class(q, out, pages, verdicts, single, gen, q.where("query_id < 3")).collect()}
    assert got == {0: "thin_evidence", 1: None, 2: "answer_absent", 3: "no_hits"}


def test_coverage(spark):
    q = spark.createDataFrame([(1, "Rust HTML to markdown libraries"), (2, "the of"), (3, "Rust")], "query_id long, query string")
    p = spark.createDataFrame([(1, "Rust is a language", "")], "query_id long, text string, source_title string")
    got = {r["query_id"]: (r["coverage"], r["uncovered"]) for r in verification.coverage(q, p).collect()}
    assert got == {1: (0.25, ["html", "markdown", "libraries"]), 2: (1.0, []), 3: (1.0, [])}


def test_cache():
    now = [0.0]
    cache = ResultCache(2, lambda: now[0])
    cache.put("a", 1, 10)
    cache.put("b", 2, 20)
    cache.put("c", 3, 30)
    assert cache.get("a") is None and cache.get("b") == 2 and cache.get("c") == 3
    now[0] = 25
    assert cache.get("b") is None
    assert result_ttl("latest rust") == 900 and result_ttl("rust docs") == 14_400 and result_ttl("gold") == 3_600 and result_ttl("gold", "day") == 900
    assert cache_key(" A ", SearchOptions()) == cache_key("a", SearchOptions()) != cache_key("a", SearchOptions(max_candidates=4))


def test_single_flight():
    runs, c = [], Coalescer()

    def work():
        runs.append(1)
        time.sleep(0.2)
        return 7

    out = []
    threads = [threading.Thread(target=lambda: out.append(c.run("k", work, 2))) for _ in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert out == [7] * 5 and len(runs) == 1 and not c.flights
    slow = threading.Thread(target=lambda: c.run("s", lambda: time.sleep(0.6), 1))
    slow.start()
    time.sleep(0.05)
    began = time.time()
    assert c.run("s", lambda: 9, 0.08) == 9 and time.time() - began < 0.4
    slow.join()
    with pytest.raises(ValueError):
        c.run("e", lambda: (_ for _ in ()).throw(ValueError()), 1)
    assert not c.flights


def test_engine(spark):
    calls = []
    engine = EngineBuilder(spark).with_fetch_concurrency(0).with_source(lambda q, o: calls.append(q) or q.upper()).build()
    assert engine.search("  ") is None and engine.search(" gold ") == "GOLD" == engine.search("Gold") and calls == ["gold"]
    assert engine.options.fetch_concurrency == 1 and len(engine.providers) == 5
    with pytest.raises(InvalidConfiguration):
        EngineBuilder(spark).with_providers([]).build()
