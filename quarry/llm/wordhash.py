"""64-bit hashes of words and of windows of words, worked out in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.pretokens import _powers_to, mixed

_KEPT_WORDS = 1_000_000
#: Bits that a membership filter has at most (32 MB, in the driver and each worker).
MOST_BITS = 1 << 28


class WordHashes:
    """Hashes of byte words; those met lately are remembered."""

    def __init__(self, seed: int = 0):
        self.seed, self.known = seed, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > _KEPT_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, self.seed)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes; none if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers_to(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mixed((total[width:] - total[:-width]) * down[:n])


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTES_AT_ONCE = 1_500_000


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many words each text has; no
    object is made for a word."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[joined]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.append(0, edge)
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers_to(len(joined) + 1)
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[: len(joined)], out=total[1:])
    length = ends - starts
    hashes = mixed(((total[ends] - total[starts]) * down[starts]) ^ (length.astype(np.uint64) << np.uint64(56)))
    for i in np.flatnonzero(length > 64).tolist():  # by a hash that no pattern of letters defeats
        hashes[i] = xxhash.xxh64_intdigest(joined[starts[i] : ends[i]].tobytes())
    text_end = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, text_end), prepend=0)


def _batches(texts: list[bytes]) -> Iterator[list[bytes]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _BYTES_AT_ONCE):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def hashed_texts(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The hashes of the words of each text."""
    for some in _batches(texts):
        hashes, counts = word_hashes(some)
        yield from np.split(hashes, np.cumsum(counts)[:-1])


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` words
    (of all its words, if it has fewer); empty without words."""
    for some in _batches(texts):
        hashes, counts = word_hashes(some)
        windows = window_hashes(hashes, width)
        first = 0
        for n in counts.tolist():
            if n >= width:
                yield np.unique(windows[first : first + n - width + 1])
            else:
                yield window_hashes(hashes[first : first + n], n) if n else hashes[:0]
            first += n


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, values
    while span * 2 <= width:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - span : width - span + n])


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


class Filter:
    """A bitmap that holds every given value (and by chance some others, so
    whatever passes is joined exactly afterwards), of 16 bits or more a value.
    Where MOST_BITS are too few for that there is none, and everything passes."""

    def __init__(self, values: DataFrame, col: str, most_bits: int = MOST_BITS):
        n = values.agg(F.approx_count_distinct(col)).first()[0]
        self.bits = max(1 << 16, 1 << (16 * n).bit_length())
        if self.bits > most_bits:
            self.shared = None
            return
        at = F.pmod(F.col(col), F.lit(self.bits)) + 1
        pages = values.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        whole = np.zeros(self.bits // 8, np.uint8)
        for page, part in pages.toLocalIterator():  # at most bits / 2 ** 15 rows of 4 KB
            at_byte = (page - 1) * 4096
            whole[at_byte : at_byte + len(part)] = np.frombuffer(part, np.uint8)
        self.shared = values.sparkSession.sparkContext.broadcast(whole.tobytes())

    @property
    def passes_all(self) -> bool:
        return self.shared is None

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """Which of the (unsigned) values may be in."""
        if self.shared is None:
            return np.ones(len(values), bool)
        table = np.frombuffer(self.shared.value, np.uint8)
        at = (values % np.uint64(self.bits)).astype(np.int64)
        return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
