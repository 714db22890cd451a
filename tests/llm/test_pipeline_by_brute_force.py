"""The whole pipeline against a plain version of each stage: quality by its
SQL, lines, sets, passages and pieces in Python, each on what the one before has kept."""

import collections
import random
import re
import zlib

import duckdb
import pandas as pd
import public_tokenizers
import pytest
from test_texts import brute_groups, oracle
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import line_dedup, quality
from quarry.llm.store import written

LIMIT = 2_048


@pytest.fixture(scope="module")
def corpus(sf, tmp_path_factory):
    """The small table, and rows for each stage to act on."""
    docs = duckdb.sql(f"SELECT * FROM read_parquet('{sf}/documents.parquet') ORDER BY doc_id").df()
    rng = random.Random(8)
    words = lambda n: [f"{rng.choice('bcdfg')}o{rng.choice('lmnrs')}{rng.choice('aeiou')}{i % 97}" for i in (rng.randrange(10**6) for _ in range(n))]
    passage, page = " ".join(words(60)), words(200)
    texts = []
    for i in range(24):  # a line of 12 sites, and a shared passage in every other
        texts.append(" ".join(words(40)) + "\nRead more on our page\n" + (passage if i % 2 else " ".join(words(30))))
    for i in range(20):  # a chain of near copies
        page = list(page)
        page[(i * 37) % len(page)] = f"edit{i}"
        texts.append(" ".join(page))
    texts += [passage, "#$% <> " * 40, "short", "", " ".join(words(9_000))]  # of one passage only, junk, short, empty, long
    base = docs.iloc[0]
    added = [{**base, "doc_id": 10_000 + i, "text": t, "source": f"site{i % 12}", "lang": "en", "n_chars": len(t)} for i, t in enumerate(texts)]
    whole = pd.concat([docs, pd.DataFrame(added)]).astype(docs.dtypes.to_dict())
    folder = str(tmp_path_factory.mktemp("corpus"))
    duckdb.sql(f"COPY (SELECT * FROM whole) TO '{folder}/documents.parquet' (FORMAT parquet)")
    return folder, [tuple(r) for r in whole[["doc_id", "text", "source"]].itertuples(index=False)]


def brute_quality(folder, rows):
    kept = dict(oracle(folder, quality.ORACLES["op5_quality"], ["doc_id", "kept"]))
    return [r for r in rows if kept[r[0]]]


def brute_lines(rows):
    sites, first = collections.defaultdict(set), {}
    for key, text, site in rows:
        for line in text.split("\n"):
            if re.search(r"[^\W_]", line):
                sites[line].add(site)
                first[line] = min(key, first.get(line, key))
    times = collections.Counter(text for _, text, _ in rows)
    out = []
    for key, text, site in rows:
        lines = text.split("\n")
        left = [x for x in lines if len(sites[x]) < line_dedup.MIN_SITES or first[x] == key]
        before, after = (sum(map(len, x)) for x in (lines, left))
        whole = after == 0 or (times[text] > 1 and before - after > before / 2)
        out.append((key, text if whole else "\n".join(left), site))
    return out


def brute_near(rows):
    groups = brute_groups([(k, t) for k, t, _ in rows], 5, 80, 100)
    return [r for r in rows if groups[r[0]][1] == r[0]]


def brute_passages(rows, width=50):
    words = {k: t.encode().split() for k, t, _ in rows}
    windows = lambda w: ((a, tuple(w[a : a + width])) for a in range(len(w) - width + 1))
    first = {}
    for k, w in words.items():
        for _, x in windows(w):
            first[x] = min(k, first.get(x, k))
    out = []
    for k, text, site in rows:
        gone = {a + j for a, x in windows(words[k]) if first[x] < k for j in range(width)}
        left = [x for i, x in enumerate(words[k]) if i not in gone]
        if left or not gone:
            out.append((k, b" ".join(left).decode() if gone else text, site))
    return out


def test_stages_and_run(spark, corpus):
    folder, rows = corpus
    table = spark.read.parquet(f"{folder}/documents.parquet")
    columns = table.columns
    brute = [lambda r: brute_quality(folder, r), brute_lines, brute_near, brute_passages]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, brute):
        before, rows = rows, plain(rows)
        table = written(stage(spark, table, folder), name)
        got = table.collect()
        assert table.columns == columns
        assert sorted((r["doc_id"], r["text"], r["source"]) for r in got) == sorted(rows), name
        assert all(r["n_chars"] == len(r["text"]) for r in got)
        assert rows != before, f"{name} had nothing to do"

    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(pieces) == {k for k, _, _ in rows}
    for key, text, _ in rows:
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 0], 0
        own = sorted(pieces[key], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // LIMIT)))
        for r in own:
            part = ids[at : at + r["length"]]
            assert (r["start"], len(part)) == (at, r["length"]) and 0 < len(part) <= LIMIT
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += len(part)
        assert at == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= LIMIT
