"""The k-d tree over distinct texts, worked out in plain Python."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from quarry.llm import sharding


def code(value):
    return (42 if value is None else xxhash.xxh64_intdigest(value, 42)) % 65536


def tree(rows, shards):
    points = {}
    for _, text, lang, source in rows:
        p = points.setdefault(text or "", [0, None, None])
        p[0] += len((text or "").encode()) + 1
        p[1], p[2] = (min((x for x in (a, b) if x is not None), default=None) for a, b in ((p[1], lang), (p[2], source)))
    placed = []
    for text, (size, lang, source) in points.items():
        tie = int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
        at = (code(lang), code(source), min(65535, math.floor(math.log2(len(text.encode()) + 1) * 1024)))
        placed.append((text, size, at, tie))
    spans = [max(p[2][d] for p in placed) - min(p[2][d] for p in placed) for d in range(3)]
    out = {}

    def split(members, first, leaves):
        if leaves == 1 or not members:
            out.update((p[0], first) for p in members)
            return
        width = [(max(p[2][d] for p in members) - min(p[2][d] for p in members)) / max(1, spans[d]) for d in range(3)]
        d = width.index(max(width))
        weights = defaultdict(int)
        for p in members:
            weights[p[2][d] << 32 | p[3]] += p[1]
        total = sum(weights.values())
        need, before = total * (leaves // 2) / leaves, 0
        for key in sorted(weights):
            if before + weights[key] >= need:
                break
            before += weights[key]
        over = before + weights[key] - need
        if before and (need - before < over or before + weights[key] >= total):
            key -= 1
        left = [p for p in members if (p[2][d] << 32 | p[3]) <= key]
        split(left, first, leaves // 2)
        split([p for p in members if (p[2][d] << 32 | p[3]) > key], first + leaves // 2, leaves - leaves // 2)

    split(placed, 0, shards)
    return out


@pytest.mark.parametrize("shards", [2, 7, 16])
def test_as_the_tree(spark, docs, odd, shards):
    hot = spark.createDataFrame([(10_000 + i, "a hot text that very many rows hold", "en", f"src{i % 9}") for i in range(150)], "doc_id long, text string, lang string, source string")
    table = docs.select("doc_id", "text", "lang", "source").unionByName(odd.select("doc_id", "text", "lang", "source").where("doc_id IS NULL OR doc_id <> 8")).unionByName(hot)
    rows = [tuple(r) for r in table.collect()]
    want = tree(rows, shards)
    got = sharding.shard(table, shards=shards, rows_per_block=40).collect()
    by_crc = {zlib.crc32(t.encode()): s for t, s in want.items()}
    assert Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), want[t or ""]) for i, t, *_ in rows) == Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got)
    assert all(by_crc[r["text_crc32"]] == r["shard"] for r in got) and len(got) == len(rows)
    for s in range(shards):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_few_texts(spark):
    rows = [(i, "one", "en", "a") for i in range(50)] + [(60, "two words", "en", "a")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=16).collect()
    one, other = ({r["shard"] for r in got if (r["doc_id"] < 60) is few} for few in (True, False))
    assert len(one) == len(other) == 1 and one != other
