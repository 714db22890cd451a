"""What the byte-level vocabularies hold, read once in each worker."""

from __future__ import annotations

import base64
import functools
import json

import numpy as np

from quarry.llm.pretokens import LETTER, NUMBER, OTHER, SPACE, Cuts, Splitter


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for the 256 bytes in .json vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class JsonVocab:
    """Bytes, merge ranks and added tokens of a byte-level BPE .json file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = _byte_letters(), spec["model"]["vocab"]
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = (left << 20) | right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank, self.pair_id = keys[order], order, merged[order]
        # A merge is tame if its token is in no pair of lower rank: all its places can then be merged at once.
        part_of = np.full(max(ids.values()) + 1, 1 << 40, np.int64)
        np.minimum.at(part_of, left, np.arange(len(left)))
        np.minimum.at(part_of, right, np.arange(len(left)))
        self.tame = part_of[merged] > np.arange(len(left))
        self.tokens = [bytes(letters[c] for c in a + b) for a, b in pairs]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokenizer = Tokenizer.from_file(path)
        self.splitter = Splitter(self._class_of)
        self._cuts: Cuts | None = None

    @property
    def cuts(self) -> Cuts:
        if self._cuts is None:
            self._cuts = Cuts(self.tokens)
        return self._cuts

    def _class_of(self, c: str) -> int:
        pieces = [b - a for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}")]
        if len(pieces) == 1:
            return LETTER
        for probe, kind in (("1", NUMBER), ("!", OTHER)):
            if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(probe + c)) == 1:
                return kind
        return SPACE


@functools.cache
def json_vocab(path: str) -> JsonVocab:
    return JsonVocab(path)


class RankVocab:
    """Tokens of a .tiktoken rank file; the class of a code point is found by
    whether the library joins it to a letter, a digit or a sign before it."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        singles = {bytes([b]): b for b in range(256)}
        joined = {p + bytes([b]): 256 + 256 * k + b for k, p in enumerate((b"a", b"1", b"!")) for b in range(256)}
        self._probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=singles | joined, special_tokens={})
        self.splitter = Splitter(self._class_of)
        self._cuts: Cuts | None = None

    @property
    def cuts(self) -> Cuts:
        if self._cuts is None:
            self._cuts = Cuts([t for t in self.ranks if len(t) > 1])
        return self._cuts

    def _class_of(self, c: str) -> int:
        n = len(c.encode()) + 1
        for probe, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(self._probe.encode_ordinary(probe + c)) < n:
                return kind
        return SPACE


@functools.cache
def rank_vocab(path: str, pattern: str) -> RankVocab:
    return RankVocab(path, pattern)


def segments(texts: list[str], specials: dict[str, int]) -> tuple[list[str], np.ndarray, list[int], list[int]]:
    """Texts cut around special strings: segments, the text each is from, which
    segments are special strings, and the ids of those."""
    parts, owner, special, special_ids = [], [], [], []
    for i, text in enumerate(texts):
        found = [s for s in specials if s in text]
        if not found:
            parts.append(text)
            owner.append(i)
            continue
        while text:
            at, s = min(((text.find(s), s) for s in found if s in text), default=(len(text), ""))
            if at:
                parts.append(text[:at])
                owner.append(i)
            if s:
                special.append(len(parts))
                special_ids.append(specials[s])
                parts.append(s)
                owner.append(i)
            text = text[at + len(s) :]
    return parts, np.array(owner, np.int64), special, special_ids
