import random

import pytest

from quarry.llm import quality


def prose(rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(40))


def symbols(rng):
    return " ".join(f"{w} #$% <>" for w in prose(rng).split())


@pytest.mark.parametrize("percent", [9, 11, 15, 33, 45])
def test_junk_does_not_move_its_fence(spark, percent):
    rng = random.Random(percent)
    n = 300
    rows = [(i, symbols(rng) if i < n * percent // 100 else prose(rng), "en", "a") for i in range(n)]
    got = quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("doc_id", "kept").collect()
    assert {r["doc_id"] for r in got if r["kept"]} == set(range(n * percent // 100, n))


def test_a_source_of_junk_alone(spark):
    """A third of all rows, in one source: its language's fences hold."""
    rng = random.Random(1)
    rows = [(i, symbols(rng) if i % 3 == 0 else prose(rng), "en", "junk" if i % 3 == 0 else "good") for i in range(900)]
    got = quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("doc_id", "kept").collect()
    assert {r["doc_id"] for r in got if r["kept"]} == {i for i in range(900) if i % 3}
