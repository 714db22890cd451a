from test_texts import brute_groups, noisy

from quarry.llm import jaccard


def test_five_words_at_eighty_percent(spark):
    """The setting of the pipeline's near_duplicates."""
    rows = noisy(250)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard.similar_groups(df, 5, 80, 100).collect()}
    want = brute_groups(rows, 5, 80, 100)
    assert got == want
    stay = {r["doc_id"] for r in jaccard.one_of_each(df, width=5, num=80, den=100).collect()}
    assert stay == {i for i, _ in rows if want[i][-1] == i}
    assert len(stay) < len(rows)
