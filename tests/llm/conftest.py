import pytest

LONG = " ".join(f"wörd{i % 700}" for i in range(30_000)) + "\n" + "x" * 5_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, and columns whose names clash with those of operators."""
    rows = [
        (5, "the same text of some words which is here twice " * 12, "en", "a"),
        (5, "the same text of some words which is here twice " * 12, "en", "a"),
        (3, "the same text of some words which is here twice " * 12, "en", "b"),
        (4, None, "en", None),
        (6, "", None, "a"),
        (7, " \n\t ", "de", "a"),
        (8, LONG, "en", "b"),
        (None, "no id, Licensed under the Apache License", "en", "a"),
        (None, None, None, None),
        (9, "naïve 漢字 🙂 it's <|endoftext|> done", "xx", "c"),
        (10, "short", "en", "a"),
    ]
    clash = [(*r, i, "x", 0.5, 1, True, 2) for i, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_tokens long, _t string, score double, shard int, kept boolean, component_id long"
    return spark.createDataFrame(clash, schema)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.collect())
