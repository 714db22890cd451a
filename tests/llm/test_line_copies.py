from quarry.llm import line_dedup


def removed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.without_boilerplate(df).collect()}


def test_only_copies_stay_whole(spark):
    """A short page made mostly of boilerplate loses it; an exact copy does not."""
    line = "this boilerplate line is everywhere and long"
    rows = [(i, f"own words of page number {i} stand here and go on for a while\n{line}", f"s{i % 12}") for i in range(24)]
    page, copy = f"short page\n{line}", f"a copy\n{line}\n{line}"
    got = removed(spark, [*rows, (50, page, "s1"), (60, copy, "s1"), (61, copy, "s2")])
    assert got[50] == ("short page", 1)
    assert got[60] == got[61] == (copy, 0)


def test_short_lines_count(spark):
    rows = [(i, f"own words of page number {i} stand here and go on for a while\nLes.\n--\nÄ 1", f"s{i % 12}") for i in range(24)]
    got = removed(spark, rows)
    assert got[0][1] == 0 and all(got[i] == (rows[i][1].replace("\nLes.", "").replace("\nÄ 1", ""), 2) for i in range(1, 24))
