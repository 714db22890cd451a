import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, ranking
from quarry.options import EngineOptions, InvalidConfiguration, RankingPolicy, SearchOptions


def passages(spark, texts, query="alpha beta", title=""):
    rows = [(1, query, 0, i, t, title, f"https://e.org/{i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id long, query string, page_ord int, passage_index int, text string, source_title string, source_url string")


def naive_words(text, size, overlap):
    size = size or 150
    overlap = min(30, size - 1) if overlap >= size else overlap
    w, out, start = text.split(), [], 0
    while start < len(w):
        out.append(" ".join(w[start : start + size]))
        if start + size >= len(w):
            break
        start += max(size - overlap, 1)
    return out


def naive_paragraphs(text, size, overlap):
    blocks = [b.strip() for b in text.split("\n\n") if b.strip()]
    if len(blocks) <= 1:
        return naive_words(text, size, overlap)
    out, cur = [], []
    count = lambda bs: sum(len(b.split()) for b in bs)
    for b in blocks:
        if len(b.split()) > size:
            if cur:
                out.append("\n\n".join(cur))
            cur = []
            out += naive_words(b, size, overlap)
            continue
        if cur and count(cur) + len(b.split()) > size:
            out.append("\n\n".join(cur))
            while count(cur) > overlap and len(cur) > 1:
                cur.pop(0)
        cur.append(b)
    return out + (["\n\n".join(cur)] if cur else [])


@pytest.mark.parametrize("size,overlap", [(150, 30), (10, 3), (5, 9), (0, 0), (1, 0)])
def test_word_passages(spark, size, overlap):
    texts = ["", "  ", "one", " ".join(f"w{i}" for i in range(350)), " ".join(f"w{i}" for i in range(10)), "a b\tc\n\nd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r["i"]: r["p"] for r in df.select("i", chunking.word_passages("t", size, overlap).alias("p")).collect()}
    assert [found[i] for i in range(len(texts))] == [naive_words(t, size, overlap) for t in texts]


def test_paragraph_passages(spark):
    import random

    rng = random.Random(5)
    texts = ["\n\n".join(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 3, 8, 20, 45]))) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r["i"]: r["p"] for r in df.select("i", chunking.paragraph_passages("t", 30, 8).alias("p")).collect()}
    assert [found[i] for i in range(len(texts))] == [naive_paragraphs(t, 30, 8) for t in texts]


def test_bm25_order_and_scaling(spark):
    ranked = ranking.ranked(passages(spark, ["alpha beta gamma", "alpha only here", "nothing at all"])).orderBy("rank").collect()
    assert [r["passage_index"] for r in ranked] == [0, 1] and ranked[0]["score"] == 1.0 and ranked[1]["dense_score"] is None


def test_lone_passage_is_calibrated_to_one(spark):
    assert ranking.ranked(passages(spark, ["alpha"])).first()["score"] == 1.0


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), ([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(ranking.cosine("a", "b")).collect()] == [-1.0, 0.0, 0.0, 0.0, 1.0]


def test_dense_and_hybrid(spark):
    embed = lambda texts: [[float("alpha" in t), float("beta" in t), 1.0] for t in texts]
    own = passages(spark, ["alpha beta", "gamma", "beta"])
    dense = ranking.ranked(own, "dense", embed).orderBy("rank").collect()
    assert dense[0]["passage_index"] == 0 and abs(dense[0]["score"] - 1) < 1e-6
    agreed = spark.createDataFrame([(1, "e.org/2")], "query_id long, url_key string")
    hybrid = {r["passage_index"]: r for r in ranking.ranked(own, "hybrid", embed, agreed).collect()}
    assert abs(hybrid[0]["score"] - 1.0) < 1e-6 and hybrid[2]["raw_score"] > 0.65


def test_two_stages_embed_the_best_only(spark):
    own = ranking.with_bm25(passages(spark, [f"alpha {'beta ' * (i % 3)} t{i}" for i in range(15)]))
    assert ranking.top_for_embedding(own, RankingPolicy(rerank_top=4)).where("to_embed").count() == 4


def test_faulty_embedders(spark):
    for bad in (lambda ts: [[1.0]] * (len(ts) - 1), lambda ts: [[float("nan")]] * len(ts), lambda ts: [[]] * len(ts)):
        with pytest.raises(Exception):
            ranking.ranked(passages(spark, ["alpha", "beta"]), "dense", bad).collect()
    with pytest.raises(InvalidConfiguration):
        ranking.ranked(passages(spark, ["alpha"]), "dense")


def test_penalty_and_floor(spark):
    own = passages(spark, ["Python 3.13 is out", "nothing of that"], "Python 3.13").withColumn("score", F.lit(0.9))
    got = {r["passage_index"]: r["score"] for r in ranking.penalised(own).collect()}
    assert got[0] == 0.9 and abs(got[1] - 0.1) < 1e-9
    assert ranking.floored(ranking.penalised(own)).count() == 1
    assert ranking.floored(ranking.penalised(own), RankingPolicy(min_score=0.0)).count() == 2


def test_near_duplicates_are_greedy(spark):
    # a ~ b and b ~ c, but not a ~ c: b goes because of a, so c stays.
    texts = [" ".join(f"w{i}" for i in range(k, k + 20)) for k in (0, 2, 4)] + ["...", "!!!"]
    own = passages(spark, texts).withColumns({"score": 1 - F.col("passage_index") / 10, "raw_score": F.lit(0.0)})
    assert sorted(r["passage_index"] for r in ranking.without_near_duplicates(own).collect()) == [0, 2, 3, 4]


def test_options():
    assert SearchOptions(max_candidates=12).pool == 12 and SearchOptions().pool == 5 and SearchOptions(max_candidates=7).pool == 8
    for bad in ({"providers": []}, {"fetch_timeout_ms": 0}, {"max_response_bytes": 0}, {"providers": ["none"]}):
        with pytest.raises(InvalidConfiguration):
            EngineOptions(**bad)
    assert EngineOptions(searxng_url=" ", fetch_concurrency=0).searxng_url is None
