"""Token counts by rank-synchronous merging of ragged arrays.

All new pre-tokens of a batch lie in one flat array of symbols with a row
number each.  In every step each row finds its pair of lowest rank and merges
that pair's occurrences from the left, all rows at once; rows without a pair
leave.  The symbols that survive are the tokens.  A count is kept by the
pre-token's key for later batches of the same worker, in bounded memory.

Long pre-tokens are first cut where no token of the vocabulary can lie.  What is
still long has its places sorted by rank, and each step then touches only the places
of one rank and their neighbours, so that the work does not grow with the steps.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.byte_vocab import JsonVocab, json_vocab, segments
from quarry.llm.pretokens import Known, chunks, distinct
from quarry.llm.store import documents, id_and_text, tidy

_NO_RANK = np.int64(1 << 40)
#: Bytes from which a word is cut, and from which a part has its places sorted.
LONG, VERY_LONG = 48, 2_000


def merged_lengths(words: list[bytes], vocab: JsonVocab) -> np.ndarray:
    """How many symbols are left of each word."""
    parts, owner = [], []
    for i, w in enumerate(words):
        own = [w] if len(w) < LONG else vocab.cuts(w)
        parts += own
        owner += [i] * len(own)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    left = np.zeros(len(parts), np.int64)
    short = np.flatnonzero(size < VERY_LONG)
    left[short] = _rows_left([parts[i] for i in short.tolist()], vocab)
    for i in np.flatnonzero(size >= VERY_LONG).tolist():
        left[i] = _left_of_one(parts[i], vocab)
    return np.bincount(owner, left, len(words)).astype(np.int64)


def _ranked(a: np.ndarray, b: np.ndarray, vocab: JsonVocab) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the pairs (a, b), and where they are in the vocabulary's tables."""
    key = (a << 20) | b
    at = np.minimum(np.searchsorted(vocab.pair_keys, key), len(vocab.pair_keys) - 1)
    return np.where(vocab.pair_keys[at] == key, vocab.pair_rank[at], _NO_RANK), at


def _without_overlaps(pos: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Every second one of places that follow each other (as in "aaa")."""
    numbers = np.arange(len(pos))
    since = numbers - np.maximum.accumulate(np.where(follows, 0, numbers))
    return pos[since % 2 == 0]


def _left_of_one(word: bytes, vocab: JsonVocab) -> int:
    """The same for one very long word; symbols are a linked list."""
    symbols = vocab.byte_ids[np.frombuffer(word, np.uint8)]
    n = left = len(symbols)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank = np.full(n, _NO_RANK)
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def placed(at: np.ndarray) -> None:
        """Work out the ranks of the pairs that begin at these places."""
        at = at[after[at] < n]
        rank[at] = _ranked(symbols[at], symbols[after[at]], vocab)[0]
        at = at[rank[at] < _NO_RANK]
        at = at[np.argsort(rank[at], kind="stable")]
        firsts = np.flatnonzero(np.append(True, np.diff(rank[at]) > 0)) if len(at) else []
        for a, b in zip(firsts, [*firsts[1:], len(at)]):
            r = int(rank[at[a]])
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(heap, r)
            waiting[r].append(at[a:b])

    placed(np.arange(n))
    while heap:
        r = heapq.heappop(heap)
        pos = np.unique(np.concatenate(waiting.pop(r)))
        pos = pos[rank[pos] == r]
        if not len(pos):
            continue
        if not vocab.tame[r]:
            if len(pos) > 1:
                waiting[r] = [pos[1:]]
                heapq.heappush(heap, r)
            pos = pos[:1]
        pos = _without_overlaps(pos, np.append(False, pos[1:] == after[pos[:-1]]))
        gone = after[pos]
        symbols[pos] = vocab.pair_id[_ranked(symbols[pos], symbols[gone], vocab)[1]]
        rank[gone] = rank[pos] = _NO_RANK
        after[pos] = after[gone]
        inner = after[pos] < n
        before[after[pos][inner]] = pos[inner]
        left -= len(pos)
        ahead = before[pos]
        ahead = ahead[ahead >= 0]
        rank[ahead] = _NO_RANK
        placed(np.union1d(pos, ahead))
    return left


def _rows_left(words: list[bytes], vocab: JsonVocab) -> np.ndarray:
    n_rows = len(words)
    size = np.fromiter(map(len, words), np.int64, n_rows)
    symbols = vocab.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    row = np.repeat(np.arange(n_rows), size)
    out = size.copy()
    while len(symbols) > 1:
        found, at = _ranked(symbols[:-1], symbols[1:], vocab)
        rank = np.append(np.where(row[:-1] == row[1:], found, _NO_RANK), _NO_RANK)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(rank, first)
        lengths = np.diff(np.append(first, len(symbols)))
        least_here = np.repeat(least, lengths)
        chosen = (rank == least_here) & (least_here < _NO_RANK)
        if not chosen.any():
            break
        pos = np.flatnonzero(chosen)
        pos = pos[vocab.tame[rank[pos]] | np.append(True, row[pos[1:]] != row[pos[:-1]])]
        pos = _without_overlaps(pos, np.append(False, np.diff(pos) == 1))
        symbols[pos] = vocab.pair_id[at[pos]]
        keep = np.ones(len(symbols), bool)
        keep[pos + 1] = False
        np.subtract.at(out, row[pos], 1)
        # Rows without a pair are done.
        keep &= least_here < _NO_RANK
        symbols, row = symbols[keep], row[keep]
    return out


class _Counter:
    def __init__(self, path: str):
        self.vocab, self.known = json_vocab(path), Known()
        self.lengths = np.zeros(0, np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        parts, owner, special, _ = segments(texts, self.vocab.specials)
        p = self.vocab.splitter.split(parts, special)
        if not len(p.starts):
            return np.zeros(len(texts), np.int64)
        firsts, codes = distinct(p.keys, p.checks)
        if self.known.size > self.known.most:
            self.known.clear()
            self.lengths = self.lengths[:0]
        slots = self.known.find(p.keys[firsts], p.checks[firsts])
        if (new := np.flatnonzero(slots < 0)).size:
            words = [p.text(i).encode() for i in firsts[new].tolist()]
            found = merged_lengths(words, self.vocab)
            for k, w in enumerate(words):
                if w.decode() in self.vocab.specials:
                    found[k] = 1
            slots[new] = self.known.add(p.keys[firsts[new]], p.checks[firsts[new]])
            self.lengths = np.concatenate([self.lengths, found])
        per_piece = self.lengths[slots][codes]
        return np.bincount(owner[p.segment], per_piece, len(texts)).astype(np.int64)


@functools.cache
def _counter(path: str) -> _Counter:
    return _Counter(path)


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null;
    repeated rows are counted each; an empty table gives an empty table; other
    columns of ``docs`` are not read.  A text of any length is counted whole.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocab_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = np.zeros(len(texts), np.int64)
            for at, part in chunks(texts):
                n[at : at + len(part)] = counter.counts(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(counted, 16_000_000), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
