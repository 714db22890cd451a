import collections
import hashlib
import re

import duckdb
import pytest

from quarry.llm import components, fingerprints, jaccard, licenses, line_dedup, quality, sharding, substrings


def oracle(sf, sql, names):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    return sorted(con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())


@pytest.mark.parametrize("module,name", [(quality, "op5_quality"), (line_dedup, "op4_line_dedup")])
def test_native_queries_as_sql(spark, sf, module, name):
    got = module.QUERIES[name](spark, sf)
    assert sorted(map(tuple, got.collect())) == oracle(sf, module.ORACLES[name], got.columns)


def test_quality_odd(spark, odd):
    got = quality.verdicts(odd)
    assert got.count() == odd.count() and got.where("n_words = 0 AND kept").count() == 0
    assert {r["n_repeat_words"] for r in got.where("doc_id = 5").collect()} == {120}
    assert quality.verdicts(odd.limit(0)).count() == 0
    assert quality.kept_documents(odd).columns == odd.columns


def test_repeat_words(spark):
    texts = ["a b c d e f", "a b c d e a b c d e", "a " * 7, "a b c d e x a b c d e f g a b c d e", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.with_measures(df).collect()}

    def brute(t):
        w = t.split()
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        return len({i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)})

    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_lines(spark, odd):
    line = "this boilerplate line is everywhere"
    rows = [(i, f"own words of page number {i} stand here and go on for a while\n{line}", f"s{i % 12}") for i in range(24)] + [(99, line, "s1"), (100, None, "s2"), (101, "", "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_dedup.without_boilerplate(df).collect()}
    assert line in got[0]["text"] and all(line not in got[i]["text"] for i in range(1, 24))
    assert got[99]["text"] == line and got[100]["text"] is None and got[101]["n_lines"] == 1
    assert line_dedup.without_boilerplate(odd).count() == odd.count()
    assert line_dedup.without_boilerplate(odd.limit(0)).count() == 0


def brute_repeats(rows, width):
    words = [(k, t.encode().split()) for k, t in rows]
    first = {}
    for k, w in words:
        for a in range(len(w) - width + 1):
            x = tuple(w[a : a + width])
            first[x] = min(k, first.get(x, k))
    out = {}
    for k, w in words:
        gone = {a + j for a in range(len(w) - width + 1) if first[tuple(w[a : a + width])] < k for j in range(width)}
        out[k] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("hot,bits", [(2_000, 1 << 28), (1, 1 << 28), (2_000, 0)])
def test_substrings(spark, docs, rows, hot, bits):
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.without_repeats(docs, digest=True, hot_strings=hot, filter_bits=bits).collect()}
    assert got == brute_repeats(rows, 50)


def test_substrings_of_few_words(spark):
    # Runs of one word and shifted passages: minimisers tie everywhere.
    rows = [(1, "a " * 90), (2, "b " * 5 + "a " * 60 + "c"), (3, " ".join(str(i % 7) for i in range(120))), (4, " ".join(str(i % 7) for i in range(3, 80)) + " end"), (5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.without_repeats(df, digest=True).collect()}
    assert got == brute_repeats(rows, 50)


def test_substrings_odd(spark, odd):
    got = substrings.without_repeats(odd).collect()
    assert len(got) == odd.count() and [r["n_removed"] for r in got if r["doc_id"] == 5] == [120, 120]
    assert [r["text"] for r in got if r["doc_id"] == 4] == [None]
    assert substrings.without_repeats(odd.limit(0)).count() == 0


def brute_groups(rows, width, num, den):
    sets = {}
    for k, t in rows:
        w = t.encode().lower().split()
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    count, holders = collections.Counter(), collections.defaultdict(list)
    for k, s in sets.items():
        for f in s:
            for other in holders[f]:
                count[other, k] += 1
            holders[f].append(k)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in count.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def noisy(n, base=300, edits=12):
    """Near copies of few texts, in chains and around each other's limits."""
    import random

    rng = random.Random(11)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.8:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        else:
            w = [f"v{rng.randrange(500)}" for _ in range(rng.randrange(5, base))]
        texts.append(" ".join(w))
    return list(enumerate(texts))


@pytest.mark.parametrize("width,num,block,few", [(3, 90, 2_048, 32), (3, 90, 3, 2), (2, 70, 2_048, 2), (2, 70, 5, 4)])
def test_jaccard(spark, width, num, block, few):
    rows = noisy(250)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard.similar_groups(df, width, num, 100, block=block, few=few).collect()}
    assert got == brute_groups(rows, width, num, 100)


def test_signatures_miss_no_pair():
    import random

    import numpy as np

    rng = random.Random(3)
    bands = jaccard.Bands(90, 100)
    for _ in range(300):
        size = rng.randrange(1, 400)
        a = {rng.getrandbits(64) for _ in range(size)}
        b = set(rng.sample(sorted(a), max(1, size - rng.randrange(size // 12 + 1)))) | {rng.getrandbits(64) for _ in range(rng.randrange(size // 12 + 1))}
        if 100 * len(a & b) >= 90 * len(a | b) and a != b:
            x, y = (np.sort(np.array(list(s), np.uint64)) for s in (a, b))
            assert set(jaccard.signatures(x, bands).tolist()) & set(jaccard.signatures(y, bands).tolist())


def test_jaccard_odd(spark, odd):
    got = jaccard.similar_groups(odd).collect()
    assert len(got) == odd.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 5)} == {3}
    assert all(r["component_id"] == r["doc_id"] for r in got if r["n_shingles"] == 0)
    assert jaccard.similar_groups(odd.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(odd).where("doc_id IS NOT NULL").collect()) == [3, 4, 6, 7, 8, 9, 10]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (200, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def test_fingerprints(spark, docs, rows):
    got = {r["doc_id"]: r for r in fingerprints.with_next(docs, rows_per_range=17).collect()}
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[1][:cut]
        r = got[key]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = bytes.fromhex(r["fingerprint"]), bytes.fromhex(got[after[0]]["fingerprint"])
        assert r["near_next"] == fingerprints.likeness(a, b)
        assert r["near_edited"] == fingerprints.likeness(a, bytes.fromhex(r["edited_fingerprint"]))


def test_fingerprints_odd(spark, odd):
    got = fingerprints.with_next(odd).collect()
    assert len(got) == odd.count() and len({r["fingerprint"] for r in got if r["doc_id"] in (3, 5)}) == 1
    assert fingerprints.with_next(odd.limit(0)).count() == 0
    nameless = odd.where("doc_id IS NULL")
    assert fingerprints.with_next(nameless).count() == 2


def test_radius_search(spark, docs):
    import random

    rng = random.Random(2)
    base = [rng.getrandbits(256) for _ in range(40)]
    all_ = [f"{x ^ sum(1 << b for b in rng.sample(range(256), rng.randrange(12))):064x}" for x in base for _ in range(4)]
    df = spark.createDataFrame([(x,) for x in [*all_, None]], "fingerprint string")
    got = {(r["query"], r["found"]): r["distance"] for r in fingerprints.within_radius(df, df, 7).collect()}
    want = {(a, b): (int(a, 16) ^ int(b, 16)).bit_count() for a in all_ for b in all_}
    assert got == {k: d for k, d in want.items() if d <= 7}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_places(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = [(a, label) for p, label in licenses.BASE.items() for a in range(len(w)) if w[a : a + len(p.split())] == p.split()]
    return len(w), sorted(a for a, _ in found), ",".join(sorted({x for _, x in found}))


def test_licenses(spark, docs, rows):
    extra = [(10_000, "CC-BY cc by, MIT License. gnu GENERAL public license; apache  license mit mit license"), (10_001, "Über CC BY"), (10_002, "gnu general public")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in licenses.scan(df)[1].collect()}
    for key, text in rows + extra:
        n, places, labels = base_places(text)
        r = got[key]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, len(places), min(places, default=None), max(places, default=None), labels)
        assert set(labels.split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_licenses_span_a_gap(spark):
    text = "Permission is hereby granted, free of ANY charge, to any person obtaining a copy of this software and associated documentation files"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans, summary = licenses.scan(df)
    assert summary.first()["labels"] == "mit" and spans.where("label = 'mit'").count() == 1


def test_licenses_odd(spark, odd):
    assert licenses.scan(odd)[1].count() == odd.count() and licenses.scan(odd.limit(0))[1].count() == 0


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_shards(spark, docs, rows, shards):
    got = sharding.shard(docs, shards=shards).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(got) == len(rows) and set(sizes) == set(range(shards))
    assert max(sizes.values()) <= sum(sizes.values()) / shards + 3 * max(r["size"] for r in got)
    for s in range(shards):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_shards_odd(spark, odd):
    got = sharding.shard(odd, target_bytes=50_000)
    assert got.count() == odd.count()
    assert sharding.shard(odd.limit(0), shards=4).count() == 0
