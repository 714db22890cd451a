"""Words of any length and kind encode as the libraries encode them, in bounded work."""

import random
import time

import numpy as np
import pytest
from test_tokens import JSON, RANKS, library, ranked  # noqa: F401
import public_tokenizers as tok

from quarry.llm import bpe, token_counts
from quarry.llm.byte_vocab import json_vocab, rank_vocab
from quarry.llm.pretokens import Known, distinct

rng = random.Random(9)
KINDS = {
    "letters": lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)),
    "one letter": lambda n: "a" * n,
    "han": lambda n: "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(n // 3)),
    "bases": lambda n: "".join(rng.choice("ACGT") for _ in range(n)),
    "parts of words": lambda n: "".join(rng.choice(["the", "ing", "ation", "quick", "over", "er", "con", "ness"]) for _ in range(n // 4)),
    "two letters": lambda n: "ab" * (n // 2),
    "signs": lambda n: "".join(rng.choice("-=_.") for _ in range(n)),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("n", [70, 500, 3_000, 60_000, 600_000])
def test_long_words(library, ranked, kind, n):  # noqa: F811
    word = KINDS[kind](n)
    began = time.time()
    assert token_counts._counter(JSON).counts([word]).tolist() == [len(library.encode(word, add_special_tokens=False).ids)]
    ids, raw = bpe.codec(RANKS, tok.PATTERN).texts([word])[0]
    assert np.frombuffer(ids, "<u4").tolist() == ranked.encode_ordinary(word) and raw.decode() == word
    assert time.time() - began < 60


def test_tokens_of_odd_rank(ranked):  # noqa: F811
    """Words around merges whose token is part of a merge of lower rank: there all
    places of a rank must not be contracted in one step."""
    codec = bpe.codec(RANKS, tok.PATTERN)
    odd = [r[0] for r in codec.db.execute("SELECT DISTINCT merged FROM rules WHERE NOT tame").fetchall()]
    assert len(odd) > 1_000
    letters = [codec.tokens[i].decode("utf-8", "ignore").strip() for i in odd]
    letters = sorted({t for t in letters if len(t) > 1 and t.isalpha()})
    words = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(300)] + [rng.choice(letters) * 60 for _ in range(300)]
    words += ["".join(rng.choice(letters[i % 50 : i % 50 + 3]) for _ in range(60)) for i in range(200)]
    got = codec.texts(words)
    assert [np.frombuffer(a, "<u4").tolist() for a, _ in got] == [ranked.encode_ordinary(w) for w in words]
    for w in words[:200]:  # the heap too
        assert codec._by_heap(w.encode())[0] == ranked.encode_ordinary(w) or w.encode() in codec.ranks


@pytest.mark.parametrize("vocab", [json_vocab(JSON), rank_vocab(RANKS, tok.PATTERN)], ids=["json", "ranks"])
def test_no_token_lies_across_a_cut(vocab):
    tokens = {t for t in vocab.ranks if len(t) > 1} if hasattr(vocab, "ranks") else set(vocab.tokens)
    longest = max(map(len, tokens))
    for kind in KINDS:
        word = KINDS[kind](300).encode()
        parts = vocab.cuts(word)
        assert b"".join(parts) == word
        free = set(np.cumsum([len(p) for p in parts])[:-1].tolist())
        crossed = {p for a in range(len(word)) for n in range(2, longest + 1) if word[a : a + n] in tokens and a + n <= len(word) for p in range(a + 1, a + n)}
        assert free == set(range(1, len(word))) - crossed


def test_keys_that_collide():
    keys, checks = np.array([5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    firsts, codes = distinct(keys, checks)
    assert codes[0] == codes[3] != codes[1] and len(firsts) == 3 and [keys[firsts[c]] for c in codes] == keys.tolist()
    known = Known()
    known.add(keys[:1], checks[:1])
    assert known.find(keys, checks).tolist() == [0, -1, -1, 0]
