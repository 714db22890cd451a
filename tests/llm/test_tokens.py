import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as tok
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe, packing, token_counts

JSON, RANKS = tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "abcstmdrevl'' \n\t  é1²9<|>endoftext._-— 　\x1c\x85漢字😀́"
FIXED = ["", "a", " ", " \n", "it's don't we'll 'stuff ' s's's", "<|endoftext|>a<|endoftext|>  x ", "a" * 3000 + "b" * 99, "<|endoftext|>" * 4, "漢字かな" * 200, " " * 700 + "x" + "\n" * 30]


def samples(n):
    rng = random.Random(1)
    any_ = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    return FIXED + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)] + ["".join(chr(rng.choice(any_)) for _ in range(30)) for _ in range(n // 5)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranked():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_and_ids_as_the_library(library):
    texts = samples(3000)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts._counter(JSON).counts(texts).tolist() == list(map(len, want))
    ids, sizes = packing._encoder(JSON).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_counts_of_any_text(texts):
    library = token_counts.json_vocab(JSON).tokenizer
    assert token_counts._counter(JSON).counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_recursive_encoding_as_the_library(ranked):
    texts = samples(600)
    got = bpe.codec(RANKS, tok.PATTERN).texts(texts)
    assert [np.frombuffer(a, "<u4").tolist() for a, _ in got] == [ranked.encode_ordinary(t) for t in texts]
    assert [b.decode() for _, b in got] == texts


def test_op1(spark, docs, rows, library):
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, JSON).collect()}
    for key, text in rows:
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[key]["n_bytes"], got[key]["n_tokens"], got[key]["over_limit"]) == (len(text.encode()), n, n > 512)


def test_op1_odd(spark, odd, library):
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_counts.count_tokens(odd, JSON).collect())
    assert got == sorted((r["doc_id"] or -1, len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert token_counts.count_tokens(odd.limit(0), JSON).count() == 0


def test_op9(spark, docs, rows, ranked):
    got = {r["doc_id"]: r for r in bpe.encode(docs, RANKS, tok.PATTERN, digests=True).collect()}
    for key, text in rows:
        ids = np.array(ranked.encode_ordinary(text), "<u4")
        want = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert tuple(got[key])[1:] == want


def test_op9_odd(spark, odd, ranked):
    got = bpe.encode(odd, RANKS, tok.PATTERN).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in got) == sorted(r["text"] or "" for r in odd.collect())
    assert bpe.encode(odd.limit(0), RANKS, tok.PATTERN).count() == 0


def check_packing(rows, capacity):
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_op2(spark, docs, rows, library):
    got = packing.packed_documents(docs, JSON).collect()
    n = check_packing(got, 2048)
    assert n <= math.ceil(sum(r["length"] for r in got) / 2048) + 2
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for key, text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by[key], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces))) and sum(p["length"] for p in pieces) == len(ids)
        assert all(p["length"] == 2048 for p in pieces[1:]) and (len(ids) > 2048) == (len(pieces) > 1)
        for p in pieces:
            assert zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]


def test_op2_odd(spark, odd):
    got = packing.packed_documents(odd, JSON, 64).collect()
    check_packing(got, 64)
    assert sum(r["piece"] == 0 for r in got) == odd.count()
    assert packing.packed_documents(odd.limit(0), JSON).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_every_plan_is_whole(counts):
    taken = {}
    seqs = {}
    for n, first, copies, times, sequence, offset in packing.best_two_fit(counts, 50):
        for j in range(copies * times):
            taken.setdefault(n, []).append(first + j)
            seqs.setdefault(sequence + j // copies, []).append((offset + j % copies * n, n))
    assert {n: sorted(x) for n, x in taken.items()} == {n: list(range(c)) for n, c in counts.items()}
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 50


def test_two_replace_the_smallest():
    # 60 + 30 leaves 10; instead of 30, 22 and 18 fill the gap of 40.
    rows = packing.best_two_fit({60: 1, 30: 1, 22: 1, 18: 1}, 100)
    first = {r[0] for r in rows if r[4] == 0}
    assert first == {60, 22, 18}
