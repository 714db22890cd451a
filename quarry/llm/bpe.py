"""Byte-level BPE encoding and decoding by DuckDB's recursive queries.

Each task runs its own in-memory DuckDB.  The distinct pre-tokens of a batch
become rows (word, position, token); a recursive query joins neighbours with
the merge table, contracts each word's leftmost pair of minimum rank, and goes
on until no word has a pair.  Decoding joins the tokens with their bytes and
aggregates in order of position.  What a word encodes to is kept for later
batches of the worker, in bounded memory; a document's ids and bytes are those
of its words in order.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.byte_vocab import rank_vocab
from quarry.llm.pretokens import Known, chunks, distinct, gathered
from quarry.llm.store import documents, id_and_text, tidy

#: Words and bytes of one recursive query: they bound its working tables.
WORDS_AT_ONCE, BYTES_AT_ONCE, MEMORY = 25_000, 500_000, "400MB"
#: From this length in bytes on, a word is first cut where no token can lie, and
#: a step contracts all places of the pair of minimum rank (from the left, without
#: overlaps) if that pair's token is in no merge of lower rank: until the
#: last of these places is done no other pair can then be the lowest.
LONG_WORD = 64
#: A part of a word that has no cut in so many bytes (runs of one pattern, DNA)
#: is contracted by a heap of (rank, place), as a step over all its rows
#: for every place would be quadratic and keep more than bounded working tables.
NO_CUT = 1_000

#: Tokens are compared by their hexadecimal digits, two for each byte.
_MERGES = """
CREATE TABLE merges AS
SELECT a.id AS left_id, b.id AS right_id, v.id AS merged
FROM (SELECT id, digits, unnest(range(2, length(digits), 2)) AS cut FROM vocab) v
JOIN vocab a ON a.digits = v.digits[1:v.cut]
JOIN vocab b ON b.digits = v.digits[v.cut + 1:]"""

#: A merge is tame if its token is part of no merge of lower rank.
_TAME = """
CREATE TABLE rules AS
WITH part AS (SELECT id, min(merged) AS least FROM (SELECT left_id AS id, merged FROM merges UNION ALL SELECT right_id, merged FROM merges) GROUP BY id)
SELECT m.left_id, m.right_id, m.merged, coalesce(p.least > m.merged, true) AS tame FROM merges m LEFT JOIN part p ON p.id = m.merged"""

#: pos is the place of a token's first byte; a merged token keeps the left one's.
_ENCODE = """
CREATE OR REPLACE TABLE encoded AS
WITH RECURSIVE state(step, word, pos, id) AS (
    SELECT 0, word, pos, id FROM symbols
    UNION ALL
    (WITH pairs AS (
        SELECT word, pos, id, lead(pos) OVER w AS next_pos, lead(id) OVER w AS next_id
        FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), best AS (
        SELECT word, min({'merged': merged, 'pos': pos, 'next_pos': next_pos}) AS b
        FROM pairs JOIN merges ON left_id = id AND right_id = next_id GROUP BY word
    )
    SELECT s.step + 1, s.word, s.pos, CASE WHEN s.pos = b.pos THEN b.merged ELSE s.id END
    FROM state s JOIN best ON best.word = s.word WHERE s.pos <> b.next_pos)
)
SELECT word, pos, id FROM state QUALIFY step = max(step) OVER (PARTITION BY word)"""

#: The same with one row for each byte that changes its id; -1: merged away.
_ENCODE_LONG = """
CREATE OR REPLACE TABLE encoded AS
WITH RECURSIVE state(word, pos, id) USING KEY (word, pos) AS (
    SELECT word, pos, id FROM symbols
    UNION
    (WITH pairs AS (
        SELECT word, pos, id, lead(pos) OVER w AS next_pos, lead(id) OVER w AS next_id, row_number() OVER w AS k
        FROM recurring.state WHERE id >= 0 WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), hits AS (
        SELECT word, pos, next_pos, merged, tame, k FROM pairs JOIN rules ON left_id = id AND right_id = next_id
        QUALIFY merged = min(merged) OVER (PARTITION BY word)
    ), runs AS (
        SELECT *, k - row_number() OVER (PARTITION BY word ORDER BY k) AS run FROM hits
    ), chosen AS (
        SELECT * FROM runs QUALIFY CASE WHEN tame THEN row_number() OVER (PARTITION BY word, run ORDER BY k) % 2 = 1 ELSE k = min(k) OVER (PARTITION BY word) END
    )
    SELECT word, unnest([pos, next_pos]), unnest([merged, -1]) FROM chosen)
)
SELECT word, pos, id FROM state WHERE id >= 0"""

_DECODE = """
SELECT word, unhex(string_agg(digits, '' ORDER BY pos)) AS bytes
FROM encoded JOIN vocab USING (id) GROUP BY word ORDER BY word"""


class Codec:
    def __init__(self, path: str, pattern: str):
        import duckdb

        self.vocab = rank_vocab(path, pattern)
        self.ranks = self.vocab.ranks
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        rows = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "digits": pa.array([t.hex().upper() for t in self.ranks])})
        self.db.register("vocab_rows", rows)
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab_rows")
        self.db.execute(_MERGES)
        self.db.execute(_TAME)
        self.known = Known()
        self._empty()

    def _empty(self) -> None:
        self.known.clear()
        self.ids, self.id_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.raw, self.raw_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _recursive(self, words: list[bytes], query: str) -> tuple[list[list[int]], list[bytes]]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), size)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        symbols = pa.table({"word": pa.array(word, pa.int32()), "pos": pa.array(pos, pa.int32()), "id": pa.array(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)])})
        self.db.register("symbols", symbols)
        self.db.execute(query)
        found = self.db.execute("SELECT word, id FROM encoded ORDER BY word, pos").fetchnumpy()
        ids = np.split(np.asarray(found["id"]), np.flatnonzero(np.diff(found["word"])) + 1)
        decoded = [bytes(b) for _, b in self.db.execute(_DECODE).fetchall()]
        self.db.unregister("symbols")
        return [x.tolist() for x in ids], decoded

    def _by_heap(self, word: bytes) -> tuple[list[int], bytes]:
        """The same contraction, leftmost place of the lowest rank first."""
        pairs, tokens, ranks = {}, self.tokens, self.ranks

        def rank_of(a: int, b: int) -> int:
            if (a, b) not in pairs:
                pairs[a, b] = ranks.get(tokens[a] + tokens[b], -1)
            return pairs[a, b]

        n = len(word)
        ids = array("i", self.byte_ids[np.frombuffer(word, np.uint8)].tobytes())
        after, before, rank = array("i", range(1, n + 1)), array("i", range(-1, n - 1)), array("i", [-1]) * n
        heap = []
        for i in range(n - 1):
            rank[i] = rank_of(ids[i], ids[i + 1])
            if rank[i] >= 0:
                heap.append(rank[i] << 32 | i)
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), 1 << 32)
            if rank[i] != r:
                continue  # changed since
            gone = after[i]
            ids[i], ids[gone], rank[gone] = r, -1, -1
            after[i] = nxt = after[gone]
            if nxt < n:
                before[nxt] = i
            for left in (before[i], i):
                if left >= 0:
                    rank[left] = rank_of(ids[left], ids[after[left]]) if after[left] < n else -1
                    if rank[left] >= 0:
                        heapq.heappush(heap, rank[left] << 32 | left)
        found = [x for x in ids if x >= 0]
        return found, b"".join(tokens[x] for x in found)

    def words(self, words: list[bytes]) -> tuple[list[list[int]], list[bytes]]:
        """The ids of each (non-empty) word and the bytes that they stand for.

        A word that is itself a token takes its rank at once, as the library does."""
        ids: list[list[int]] = [[] for _ in words]
        decoded: list[list[bytes]] = [[] for _ in words]
        parts: list[tuple[int, bytes]] = []
        for i, w in enumerate(words):
            if w in self.ranks:
                ids[i], decoded[i] = [self.ranks[w]], [w]
            else:
                parts += [(i, part) for part in ([w] if len(w) < LONG_WORD else self.vocab.cuts(w))]
        results: dict[bytes, tuple[list[int], bytes]] = {}
        for least, most, query in ((0, LONG_WORD, _ENCODE), (LONG_WORD, NO_CUT, _ENCODE_LONG)):
            todo = list(dict.fromkeys(w for _, w in parts if least <= len(w) < most))
            at = 0
            while at < len(todo):
                end, size = at, 0
                while end < len(todo) and end - at < WORDS_AT_ONCE and (end == at or size + len(todo[end]) <= BYTES_AT_ONCE):
                    size += len(todo[end])
                    end += 1
                results |= zip(todo[at:end], zip(*self._recursive(todo[at:end], query)))
                at = end
        for part in dict.fromkeys(w for _, w in parts if len(w) >= NO_CUT):
            results[part] = self._by_heap(part)
        for i, part in parts:  # in order of their words' places
            own, raw = results[part]
            ids[i] += own
            decoded[i].append(raw)
        return ids, [b"".join(d) for d in decoded]

    def texts(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded bytes) of each text."""
        p = self.vocab.splitter.split(texts)
        if not len(p.starts):
            return [(b"", b"")] * len(texts)
        firsts, codes = distinct(p.keys, p.checks)
        if self.known.size > self.known.most:
            self._empty()
        slots = self.known.find(p.keys[firsts], p.checks[firsts])
        if (new := np.flatnonzero(slots < 0)).size:
            ids, decoded = self.words([p.text(i).encode() for i in firsts[new].tolist()])
            slots[new] = self.known.add(p.keys[firsts[new]], p.checks[firsts[new]])
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            self.ids = np.concatenate([self.ids, np.fromiter((x for r in ids for x in r), np.uint32, int(n.sum()))])
            self.id_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum(n)])
            n = np.fromiter(map(len, decoded), np.int64, len(decoded))
            self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(decoded), np.uint8)])
            self.raw_at = np.concatenate([self.raw_at, self.raw_at[-1] + np.cumsum(n)])
        rows = slots[codes]
        out = []
        for flat, offsets in ((self.ids, self.id_at), (self.raw, self.raw_at)):
            values, lengths = gathered(flat, offsets, rows)
            ends = np.cumsum(np.bincount(p.segment, lengths, len(texts)).astype(np.int64)) * flat.itemsize
            raw = values.astype(flat.dtype.newbyteorder("<")).tobytes()
            out.append([raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())])
        return list(zip(*out))


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and
    decoded (bytes) of every row, or with ``digests`` their sha256.

    A null or empty text has no tokens; null ids stay null; repeated rows are
    encoded each; an empty table gives an empty table; other columns are not
    read; texts and words of any length are whole.  Of places with one rank the
    leftmost goes first.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            texts, ids, raw, n = batch.column(1).to_pylist(), [], [], []
            for _, part in chunks(texts):
                for a, b in own.texts(part):
                    n.append(len(a) // 4)
                    ids.append(hashlib.sha256(a).hexdigest() if digests else a)
                    raw.append(hashlib.sha256(b).hexdigest() if digests else b)
            kind = pa.string() if digests else pa.binary()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(raw, kind)], names=names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kind = "string" if digests else "binary"
    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(encoded, 16_000_000), f"doc_id long, n_tokens long, {names[2]} {kind}, {names[3]} {kind}")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return encode(documents(spark, sf_dir), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, digests=True)


QUERIES = {"op9_bpe": op9_bpe}
ORACLES: dict[str, str] = {}
