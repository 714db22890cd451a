"""Operators and stages carry columns of any name, nulls, odd texts and empty tables."""

import corpus_pipeline
import pytest
from quarry.llm import jaccard, line_dedup, quality, substrings
from pyspark.sql import functions as F

INTERNAL = (
    "_id _t _t1 _t2 _k _k2 _row _runs _text _bad _copied _kept _lines _words _lang _source _n_lines _new row new words lines windows text_2 there kept base_failed n_words n_removed "
    "n_lines n_symbols node rep sig pivot member component component_id n_shingles minimiser packed first smallest _site _pos _h1 _h2 _n _first high_repeat_share a.b"
).split()


@pytest.fixture(scope="module")
def clashing(odd):
    out = odd
    for i, name in enumerate(c for c in INTERNAL if c not in odd.columns):
        out = out.withColumn(name, F.concat(F.lit(f"v{i}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return out


def carried(df, but=("text", "n_chars")):
    names = [c for c in df.columns if c not in but]
    return sorted(map(repr, df.select(*[f"`{c}`" for c in names]).collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages(spark, sf, clashing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, clashing, sf)
    assert out.schema.names == clashing.columns and [f.dataType for f in out.schema] == [f.dataType for f in clashing.schema]
    left, every = carried(out), carried(clashing)
    assert set(left) <= set(every)
    if name == "line_dedup":
        assert left == every
    empty = stage(spark, clashing.limit(0), sf)
    assert empty.columns == clashing.columns and empty.count() == 0


def test_packing_stage(spark, sf, clashing):
    stage = dict(corpus_pipeline.STAGES)["packing"]
    assert stage(spark, clashing, sf).where("piece = 0").count() == clashing.count()
    assert stage(spark, clashing.limit(0), sf).count() == 0


@pytest.mark.parametrize("work,new", [(quality.verdicts, (*quality.MEASURES, "base_failed", "kept")), (line_dedup.without_boilerplate, ("n_lines", "n_removed")), (substrings.without_repeats, ("n_words", "n_removed"))])
def test_operators(clashing, work, new):
    assert carried(work(clashing), ("text", *new)) == carried(clashing, ("text", *new))


def test_whole_run_of_odd_rows(spark, sf, clashing, tmp_path):
    """Null, empty, blank and repetitive texts are rejected, sound ones packed, whatever the columns are called."""
    sound = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 500").limit(30)
    both = clashing.withColumn("n_chars", F.length("text").cast("long")).unionByName(sound.withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    both.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept and min(kept) >= 1000


def test_many_lines(spark):
    """The work of op4 is linear in the lines of a text."""
    shared = [f"shared boilerplate line number {i}" for i in range(20_000)]
    rows = [(i, "\n".join(x for j, s in enumerate(shared) for x in (s, f"own line {i} {j}")), f"s{i}") for i in range(12)]
    out = {r["doc_id"]: r for r in line_dedup.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0]["n_removed"] == 0 and all(out[i]["n_removed"] == 20_000 and out[i]["text"] == "\n".join(f"own line {i} {j}" for j in range(20_000)) for i in range(1, 12))
