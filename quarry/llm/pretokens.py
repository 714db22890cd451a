"""Vectorised pre-tokenisation for byte-level BPE vocabularies.

The pattern that both byte-level libraries use

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

cuts a text into runs of one character class, with three local exceptions, so
the cuts of a whole batch follow from comparing neighbouring classes in numpy.
Which class a code point has depends on the Unicode version a library was built
with; it is asked of that library itself, once for each code point met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
#: Characters worked on at once; a single longer text makes a chunk of its own.
CHUNK_CHARS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Pieces longer than this have their hashes from xxh3.
_LONG = 64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(max(n, CHUNK_CHARS + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of consecutive groups of limited size."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, texts[at:]


class Pieces:
    """Pre-tokens of a batch of segments: piece i is chars[starts[i]:ends[i]].
    keys and checks are two independent hashes, of 64 bits each."""

    def __init__(self, joined: str, starts: np.ndarray, ends: np.ndarray, segment: np.ndarray, keys: np.ndarray, checks: np.ndarray):
        self.joined, self.starts, self.ends, self.segment, self.keys, self.checks = joined, starts, ends, segment, keys, checks

    def text(self, i: int) -> str:
        return self.joined[self.starts[i] : self.ends[i]]


class Splitter:
    def __init__(self, classify: Callable[[str], int]):
        self.classify = classify
        self.table, self.values = np.full(0x110000, UNKNOWN, np.uint8), None

    def classes(self, cps: np.ndarray) -> np.ndarray:
        found = self.table[cps]
        if (unknown := found == UNKNOWN).any():
            for cp in np.unique(cps[unknown]).tolist():
                self.table[cp] = self.classify(chr(cp))
            found = self.table[cps]
        return found

    def split(self, segments: list[str], whole: list[int] = ()) -> Pieces:
        """``whole``: indices of non-empty segments that are one piece each."""
        joined = "".join(segments)
        n = len(joined)
        if not n:
            none = np.zeros(0, np.int64)
            return Pieces("", none, none, none, none.astype(np.uint64), none.astype(np.uint64))
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        seg_end = np.cumsum(lengths)
        seg_start = seg_end - lengths
        first = np.zeros(n + 1, bool)
        first[seg_start] = True
        first[n] = True
        cls = self.classes(cps)
        change = first[:n].copy()
        change[1:] |= cls[1:] != cls[:-1]
        a = np.flatnonzero(change)
        b = np.append(a[1:], n)
        kind, at_end = cls[a], first[b]
        mark = np.zeros(n, bool)
        # Runs of white space: the last character leaves the run if a text follows it.
        sp = kind == SPACE
        mark[a[sp & (at_end | (b - a > 1))]] = True
        last = b[sp & ~at_end] - 1
        mark[last[cps[last] != 32]] = True
        # Other runs take one blank along.
        lead = a[~sp]
        blank = (lead > 0) & ~first[lead] & (cps[lead - 1] == 32)
        mark[lead - blank] = True
        # A lone apostrophe without a blank takes the letters of a contraction along.
        quote = (kind == OTHER) & (b - a == 1) & (cps[a] == 39) & ~at_end
        if quote.any():
            q = a[quote]
            q = q[first[q] | (cps[q - 1] != 32)]
            q = q[cls[q + 1] == LETTER]
            c1 = cps[q + 1]
            two = np.minimum(q + 2, n - 1)
            c2 = np.where((q + 2 < n) & ~first[two], cps[two], 0)
            one_letter = np.isin(c1, [ord(x) for x in "stmd"])
            two_letters = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
            for hit, taken in ((one_letter, 1), (two_letters, 2)):
                p = q[hit]
                mark[p + 1] = False
                after = p + 1 + taken
                p = after[(after < n)]
                p = p[~first[p]]
                mark[p[cls[p] == LETTER]] = True
        for s in whole:
            mark[seg_start[s] + 1 : seg_end[s]] = False
        starts = np.flatnonzero(mark)
        ends = np.append(starts[1:], n)
        up, down = _powers_to(n + 1)
        spread, hashes = self._spread(cps), []
        for values in (cps.astype(np.uint64) + np.uint64(1), spread):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(values * up[:n], out=total[1:])
            hashes.append(mixed(((total[ends] - total[starts]) * down[starts]) ^ ((ends - starts).astype(np.uint64) << np.uint64(56))))
        keys, checks = hashes
        for i in np.flatnonzero(ends - starts > _LONG).tolist():
            whole = xxhash.xxh3_128_intdigest(joined[starts[i] : ends[i]])
            keys[i], checks[i] = whole >> 64, whole & (1 << 64) - 1
        segment = np.searchsorted(seg_end, starts, side="right")
        return Pieces(joined, starts, ends, segment, keys, checks)

    def _spread(self, cps: np.ndarray) -> np.ndarray:
        if self.values is None:
            self.values = mixed(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))
        return self.values[cps]


class Known:
    """A bounded map from piece keys (and checks) to rows of ragged values (worker-wide)."""

    def __init__(self, most: int = 1_500_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.uint64)
        self.keys, self.checks, self.slots, self.size = none, none, np.zeros(0, np.int64), 0

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if it is new (or shares its key with another)."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.checks[at] == checks), self.slots[at], -1)

    def add(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Slots for new keys, in order."""
        slots = np.arange(self.size, self.size + len(keys))
        self.size += len(keys)
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        self.keys, self.checks, self.slots = every[order], np.concatenate([self.checks, checks])[order], np.concatenate([self.slots, slots])[order]
        return slots


def distinct(keys: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of one occurrence of each key, and for each key its number there.
    With ``checks`` keys are one only if these agree too."""
    import pandas as pd

    codes, values = pd.factorize(keys)
    firsts = np.empty(len(values), np.int64)
    firsts[codes[::-1]] = np.arange(len(keys) - 1, -1, -1)
    if checks is not None and (checks != checks[firsts[codes]]).any():
        _, firsts, codes = np.unique(np.stack([keys, checks], axis=1), axis=0, return_index=True, return_inverse=True)
        return firsts, codes.ravel()
    return firsts, codes


def gathered(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of ragged rows flat[offsets[r]:offsets[r + 1]], and their lengths."""
    lengths = offsets[rows + 1] - offsets[rows]
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    at = np.arange(total) + np.repeat(offsets[rows] - (ends - lengths), lengths)
    return flat[at], lengths


class Cuts:
    """Places of a long word that no token can lie across.

    A merge makes a token of the vocabulary, so where no occurrence of a token
    spans a place, the word's left and right side are encoded as if alone.
    Occurrences are followed from all places at once, for as long as they are
    the beginning of some token.  Beginnings are compared by hashes; two that
    share one only hide a cut.
    """

    def __init__(self, tokens: list[bytes]):
        longest = max(map(len, tokens))
        starts: list[set[bytes]] = [set() for _ in range(longest + 1)]
        for t in tokens:
            for n in range(2, len(t) + 1):
                starts[n].add(t[:n])
        whole = set(tokens)
        self.levels = []
        for n in range(2, longest + 1):
            found = sorted((int(self._hash(s)), s in whole) for s in starts[n])
            self.levels.append((np.array([h for h, _ in found], np.uint64), np.array([w for _, w in found], bool)))

    @staticmethod
    def _sums(raw: np.ndarray) -> np.ndarray:
        up, _ = _powers_to(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
        return total

    def _hash(self, s: bytes) -> np.uint64:
        return self._sums(np.frombuffer(s, np.uint8))[-1]

    def __call__(self, word: bytes) -> list[bytes]:
        """The word's parts."""
        n = len(word)
        total = self._sums(np.frombuffer(word, np.uint8))
        down = _powers_to(n + 1)[1]
        crossed = np.zeros(n + 1, np.int64)
        at = np.arange(n - 1)
        for size, (hashes, whole) in enumerate(self.levels, 2):
            at = at[at <= n - size]
            if not len(at):
                break
            own = (total[at + size] - total[at]) * down[at]
            place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            here = hashes[place] == own
            at, place = at[here], place[here]
            tokens = at[whole[place]]
            np.add.at(crossed, tokens + 1, 1)
            np.add.at(crossed, tokens + size, -1)
        free = np.flatnonzero(np.cumsum(crossed)[1:n] == 0) + 1
        return [word[a:b] for a, b in zip([0, *free.tolist()], [*free.tolist(), n])]
