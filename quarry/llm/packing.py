"""Best-two-fit packing of documents into sequences of limited length.

Only lengths matter to a packing, and there are at most ``capacity`` of them,
so the plan is made from the histogram of lengths: fill a sequence greedily,
the longest first and then whatever fits best; replace its smallest document
by two unpacked ones that fill the widened gap more tightly; repeat the same
sequence for as long as its lengths last.  The histogram and the plan are small
whatever the corpus holds; the pieces never leave the executors.  A piece
finds its place by its number among the pieces of its length, counted per
block of pieces, so that one frequent length is spread over many tasks.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.byte_vocab import json_vocab, segments
from quarry.llm.pretokens import Known, chunks, distinct, gathered
from quarry.llm.store import block_no, documents, id_and_text, tidy, written

CAPACITY = 2048
#: Blocks over which the pieces of one length are dealt, at least.
LEAST_BLOCKS = 64


class _Encoder:
    """Token ids of texts; a pre-token's ids are asked of the library once."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.vocab, self.known = json_vocab(path), Known()
        self._empty()

    def _empty(self) -> None:
        self.known.clear()
        self.ids, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many of them each text has."""
        parts, owner, special, _ = segments(texts, self.vocab.specials)
        p = self.vocab.splitter.split(parts, special)
        if not len(p.starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        firsts, codes = distinct(p.keys, p.checks)
        if self.known.size > self.known.most:
            self._empty()
        slots = self.known.find(p.keys[firsts], p.checks[firsts])
        if (new := np.flatnonzero(slots < 0)).size:
            found = self.vocab.tokenizer.encode_batch([p.text(i) for i in firsts[new].tolist()], add_special_tokens=False)
            rows = [e.ids for e in found]
            slots[new] = self.known.add(p.keys[firsts[new]], p.checks[firsts[new]])
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            self.ids = np.concatenate([self.ids, np.fromiter((x for r in rows for x in r), np.uint32, int(sizes.sum()))])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        ids, lengths = gathered(self.ids, self.offsets, slots[codes])
        return ids, np.bincount(owner[p.segment], lengths, len(texts)).astype(np.int64)


@functools.cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def encoded_pieces(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian) of the
    pieces of every row: its token ids and then ``end_id``, cut into pieces of
    ``capacity`` ids if it is longer, the first of which takes the remainder.

    A null or empty text is the one piece of ``end_id``; null ids stay null;
    repeated rows give their pieces each; other columns are not read.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocab_path)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, part in chunks(texts):
                ids, sizes = encoder.encode(part)
                raw, ends, out = ids.astype("<u4").tobytes(), np.cumsum(sizes).tolist(), []
                for key, a, b in zip(keys[at : at + len(part)], [0, *ends], ends):
                    own = raw[4 * a : 4 * b] + end_id.to_bytes(4, "little")
                    n = b - a + 1
                    begin, piece = 0, 0
                    while begin < n:
                        size = min(n, n % capacity or capacity) if begin == 0 else capacity
                        cut = own[4 * begin : 4 * (begin + size)]
                        out.append((key, piece, begin, size, zlib.crc32(cut), cut))
                        begin, piece = begin + size, piece + 1
                columns = list(zip(*out))[: len(names)]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(encoded, 16_000_000), schema)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces of each length, as rows
    (length, first number, copies, sequences, first sequence, offset): piece
    number ``first + j`` of that length goes into sequence ``first sequence +
    j // copies`` at ``offset + (j % copies) * length``, j < copies * sequences.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    numbered: dict[int, int] = dict.fromkeys(lengths, 0)
    rows, sequence = [], 0
    while lengths:
        used: dict[int, int] = {}
        gap = capacity

        def put(n: int) -> None:
            nonlocal gap
            used[n] = used.get(n, 0) + 1
            gap -= n

        def free(n: int) -> int:
            return left[n] - used.get(n, 0)

        put(lengths[-1])
        while True:
            at = bisect_right(lengths, gap) - 1
            while at >= 0 and not free(lengths[at]):
                at -= 1
            if at < 0:
                break
            put(lengths[at])
        while gap and sum(used.values()) > 1:
            least = min(used)
            pair = _two_within(lengths, free, least, gap + least)
            if pair is None:
                break
            used[least] -= 1
            gap += least
            if not used[least]:
                del used[least]
            put(pair[0])
            put(pair[1])
        times = min(left[n] // k for n, k in used.items())
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            rows.append((n, numbered[n], k, times, sequence, offset))
            offset += n * k
            numbered[n] += k * times
            left[n] -= k * times
            if not left[n]:
                lengths.remove(n)
        sequence += times
    return rows


def _two_within(lengths: list[int], free, more_than: int, room: int) -> tuple[int, int] | None:
    """Two free lengths whose sum is the largest in (more_than, room]."""
    best, pair = more_than, None
    i, j = 0, bisect_right(lengths, room) - 1
    while i <= j:
        a, b = lengths[i], lengths[j]
        if not free(a):
            i += 1
        elif not free(b):
            j -= 1
        elif a + b > room:
            j -= 1
        else:
            if a + b > best and (i < j or free(a) > 1):
                best, pair = a + b, (a, b)
                if best == room:
                    break
            i += 1
    return pair


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_block: int = 50_000) -> DataFrame:
    """``pieces`` (with a length from 1 to ``capacity``; its table is read
    several times, so give a stored one) with sequence_id and offset.

    Columns sequence_id and offset of ``pieces``, if any, are replaced; pieces
    without a length are left out; an empty table gives an empty table.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset").where(F.col("length").between(1, capacity))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = best_two_fit(histogram, capacity)
    places = spark.createDataFrame(plan, "_n long, _first long, _copies long, _times long, _sequence long, _offset long")
    n = max(LEAST_BLOCKS, -(-sum(histogram.values()) // rows_per_block))
    order = [c for c in ("doc_id", "piece") if c in pieces.columns]
    blocks = pieces.withColumn("_block", block_no(n, *map(F.col, order)))
    before = Window.partitionBy("_n").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy(F.col("length").alias("_n"), F.col("_block").alias("_b")).agg(F.count("*").alias("_c"))
    base = base.select("_n", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_block").orderBy(*order) if order else Window.partitionBy("length", "_block").orderBy(F.lit(0))
    numbered = blocks.withColumn("_rank", F.row_number().over(own) - 1)
    numbered = numbered.join(base, (F.col("length") == F.col("_n")) & (F.col("_block") == F.col("_b"))).withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_n", "_b", "_base", "_block")
    # Broadcast: a pattern has at most sqrt(2 * capacity) lengths, and every pattern uses up one length or more of at most `capacity`.
    j = F.col("_rank") - F.col("_first")
    return (
        numbered.join(F.broadcast(places), (F.col("length") == F.col("_n")) & (j >= 0) & (j < F.col("_copies") * F.col("_times")))
        .withColumn("sequence_id", F.col("_sequence") + F.floor(j / F.col("_copies")))
        .withColumn("offset", F.col("_offset") + (j % F.col("_copies")) * F.col("length"))
        .drop("_rank", *places.columns)
    )


def packed_documents(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every row's pieces and their places; the ids are worked out once."""
    return pack(written(encoded_pieces(docs, vocab_path, capacity), "pieces"), capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
