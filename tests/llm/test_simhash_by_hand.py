"""SimHash worked out with plain integers, and the radius search in the query."""

import math
from collections import Counter

import xxhash

from quarry.llm import fingerprints

M = (1 << 64) - 1


def mix(h):
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & M
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & M
    return h ^ h >> 31


def simhash(text):
    counts = Counter(text.encode().split())
    votes, total = [0] * 256, 0
    for word, n in counts.items():
        weight = len(word) * round(16 * (1 + math.log2(n)))
        total += weight
        raw = b"".join(mix(xxhash.xxh64_intdigest(word, 0) ^ (0x9E3779B97F4A7C15 * (k + 1) & M)).to_bytes(8, "little") for k in range(4))
        for i in range(256):
            votes[i] += weight * (raw[i // 8] >> (7 - i % 8) & 1)
    return "".join(f"{int(''.join('1' if 2 * votes[i + j] > total else '0' for j in range(4)), 2):x}" for i in range(0, 256, 4))


def test_query(spark, sf, docs, rows):
    got = {r["doc_id"]: r for r in fingerprints.op8_fingerprints(spark, sf).collect()}
    own = {i: simhash(t) for i, t in rows}
    for at, (i, text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = simhash(text[: len(text) - cut] + after[:cut])
        r = got[i]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own[i], edited)
        assert r["near_edited"] == 1 - (int(own[i], 16) ^ int(edited, 16)).bit_count() / 256
        near = {f for f in own.values() if f != own[i] and (int(f, 16) ^ int(own[i], 16)).bit_count() <= fingerprints.RADIUS}
        assert r["near_others"] == (len(near) if i % 20 == 0 else None)
    assert len(got) == len(rows)


def test_equal_ids_and_repeated_rows(spark):
    rows = [(1, "b text"), (1, "a text"), (1, "a text"), (2, "next")]
    got = sorted((r["doc_id"], r["n_chars"], r["fingerprint"]) for r in fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((i, len(t), simhash(t)) for i, t in rows)
