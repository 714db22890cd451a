import random

from quarry.operators import ranking
from quarry.plans import q_rank


def greedy(rows):
    """query_id and place of the passages that stay, one by one in the order of scores."""
    stay = {}
    for q, i, text, score in sorted(rows, key=lambda r: (r[0], -r[3], r[1])):
        own = {w for w in text.split() if len(w) >= 2}
        kept = stay.setdefault(q, [])
        if not own or not any(len(own & x) / len(own | x) >= 0.8 for _, x in kept):
            kept.append((i, own))
    return sorted((q, i) for q, kept in stay.items() for i, _ in kept)


def test_greedy_as_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    rows = []
    for i in range(400):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
        rows.append((i % 2, i, " ".join(words) if i % 40 else "!", rng.randrange(8) / 8))
    df = spark.createDataFrame([(q, 0, i, t, s, 0.0) for q, i, t, s in rows], "query_id long, page_ord int, passage_index int, text string, score double, raw_score double")
    got = ranking.without_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r["query_id"], r["passage_index"]) for r in got.collect()) == greedy(rows)


def test_all_passages_enter(spark, tmp_path):
    """100 documents that have nothing in common all stay, for each query."""
    docs = [(i, " ".join(f"d{i}x{k}" for k in range(20)), "en", "s", 1) for i in range(100)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert q_rank.near_duplicates_greedy(spark, str(tmp_path)).count() == 100 * len(q_rank.ASKED)
