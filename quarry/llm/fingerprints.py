"""SimHash fingerprints, and their search by permuted block tables.

A text's distinct words vote on 256 signed bits, each with the hash of the
word, and a weight of its length times one plus the logarithm of its count.
Fingerprints within Hamming radius r agree in one of r + 1 blocks at least, so
a table for each block, keyed by it, finds all of them.

The edited text of a document ends in the beginning of the next one, by id.
Ids are dealt out by ranges whose bounds are quantiles; the first document of
a range is sent along to the range before it, so texts are moved once and every
task sees its documents in order with one document more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.pretokens import distinct, mixed
from quarry.llm.store import documents, id_and_text, tidy, written
from quarry.llm.wordhash import WordHashes

#: Every so many-th id is a query of the radius search.
BITS, RADIUS, QUERY_EVERY = 256, 7, 20
#: Ranges of rows without an id; rows that a task has at least, if there are more ranges than shuffle partitions.
_NULL_RANGES, _ROWS_OF_TASK = 16, 8_000


_WORDS_AT_ONCE = 100_000


def _often(counts: np.ndarray) -> np.ndarray:
    return np.rint(16 * (1 + np.log2(counts))).astype(np.int64)


class Hasher:
    def __init__(self) -> None:
        self.hashes = WordHashes()

    def fingerprints(self, texts: list[str]) -> list[bytes]:
        """32 bytes for each text; all zero for one without words."""
        out: list[bytes] = []
        held: list[list[bytes]] = []
        size = 0
        for text in texts:
            held.append(text.encode().split())
            size += len(held[-1])
            if size > _WORDS_AT_ONCE:
                out += self._of(held)
                held, size = [], 0
        return out + self._of(held)

    def _of(self, texts: list[list[bytes]]) -> list[bytes]:
        words = [w for ws in texts for w in ws]
        firsts, codes = distinct(self.hashes(words)) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        keys = self.hashes([words[i] for i in firsts.tolist()])
        lanes = np.stack([mixed(keys ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) for k in range(BITS // 64)], axis=1)
        bits = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(len(keys), BITS // 8), axis=1)
        length = np.array([len(words[i]) for i in firsts.tolist()], np.int64)
        out, at = [], 0
        for ws in texts:
            own, counts = np.unique(codes[at : at + len(ws)], return_counts=True)
            at += len(ws)
            votes, total = np.zeros(BITS, np.int64), 0
            for a in range(0, len(own), 4096):
                part = own[a : a + 4096]
                # Whole numbers, so that sums do not depend on their order; einsum, so that no library starts threads.
                weights = length[part] * _often(counts[a : a + 4096])
                votes += np.einsum("i,ij->j", weights, bits[part])
                total += int(weights.sum())
            out.append(np.packbits(2 * votes > total).tobytes())
        return out


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (hex) of every row; null texts count as empty."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            out = [f.hex() for f in hasher.fingerprints(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(made), "doc_id long, fingerprint string")


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS, col: str = "fingerprint", digits: int = BITS // 4) -> DataFrame:
    """query, found, distance: all pairs of distinct fingerprints (hex, of
    ``digits`` digits) of the two tables at most ``radius`` bits apart.  Rows that share a
    fingerprint share its pairs; nulls have none.  A pair comes from the first
    of the ``radius`` + 1 tables whose block the two share."""
    cuts = [i * digits // (radius + 1) for i in range(radius + 2)]
    blocks = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    block = lambda name, k: F.substring(F.col(name), blocks[k][0] + 1, blocks[k][1])

    def tables(df: DataFrame, name: str) -> DataFrame:
        distinct = df.select(F.col(col).alias(name)).where(F.length(col) == digits).distinct()
        return distinct.select(name, F.posexplode(F.array(*[block(name, k) for k in range(radius + 1)])).alias("_table", "_key"))

    pairs = tables(queries, "query").join(tables(index, "found"), ["_table", "_key"])
    first = F.lit(radius)
    for k in reversed(range(radius)):
        first = F.when(block("query", k) == block("found", k), k).otherwise(first)
    part = lambda name, k: F.conv(F.substring(F.col(name), 1 + 8 * k, 8), 16, 10).cast("long")
    distance = sum((F.bit_count(part("query", k).bitwiseXOR(part("found", k))) for k in range(-(-digits // 8))), F.lit(0))
    return pairs.where(F.col("_table") == first).select("query", "found", distance.cast("int").alias("distance")).where(F.col("distance") <= radius)


def with_neighbours(marked: DataFrame, every: int = QUERY_EVERY, radius: int = RADIUS) -> DataFrame:
    """``marked`` (a written table with doc_id and fingerprint) with near_others:
    for a row whose id is divisible by ``every`` the number of other distinct
    fingerprints of the table within ``radius``, else null."""
    asked = F.col("doc_id") % every == 0
    found = within_radius(marked.where(asked).select("fingerprint"), marked, radius)
    counts = found.where("query <> found").groupBy("query").agg(F.count("*").alias("near_others"))
    # Queries only are joined, the rest gets a null.
    queries = marked.where(asked).join(counts, F.col("fingerprint") == F.col("query"), "left").drop("query").withColumn("near_others", F.coalesce("near_others", F.lit(0)).cast("long"))
    return queries.unionByName(marked.where(F.coalesce(~asked, F.lit(True))).withColumn("near_others", F.lit(None).cast("long")))


def _literal(values: list, kind: str) -> Column:
    """An array of numbers as one literal, however many there are."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _in_ranges(texts: DataFrame, rows_per_range: int, most_ranges: int) -> DataFrame:
    """doc_id, text, _range, _kind: 1 for a document, 2 for the document that
    follows a range's last one, 0 for the one that follows rows without an id;
    in partitions of neighbouring ranges, as many as the table needs."""
    n, ids = texts.count(), texts.select("doc_id").where("doc_id IS NOT NULL")
    wanted = max(1, min(most_ranges, -(-n // rows_per_range)))
    shares = _literal([k / wanted for k in range(1, wanted)] or [0.5], "double")
    bounds = ids.agg(F.percentile_approx("doc_id", shares, max(100_000, 8 * wanted))).first()[0] or []
    bounds = sorted(set(bounds))
    side, ranges = max(1, round(len(bounds) ** 0.5)), len(bounds) + 1

    def range_of(x: Column) -> Column:
        """How many bounds are below x, counted in one stretch of them."""
        if not bounds:
            return F.lit(0)
        below = lambda values: F.size(F.filter(values, lambda b: b < x))
        stretch = F.greatest(below(_literal(bounds[::side], "bigint")) - 1, F.lit(0)) * side
        return stretch + below(F.slice(_literal(bounds, "bigint"), stretch + 1, F.lit(side)))

    numbered = texts.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(ranges) + F.pmod(F.xxhash64("text"), F.lit(_NULL_RANGES)).cast("int")).otherwise(range_of(F.col("doc_id")).cast("int")))
    # At most `most_ranges` rows: the smallest id of each range.
    firsts = sorted((r["_range"], r["f"]) for r in numbered.select("_range", "doc_id").where("doc_id IS NOT NULL").groupBy("_range").agg(F.min("doc_id").alias("f")).collect())
    dealt = numbered.withColumn("_kind", F.lit(1))
    if firsts:
        sent = {first: [(firsts[k - 1][0], 2)] for k, (_, first) in enumerate(firsts)}
        sent[firsts[0][1]] += [(ranges + s, 0) for s in range(_NULL_RANGES)]
        table = texts.sparkSession.createDataFrame([(f, r, k) for f, to in sent.items() for r, k in to], "_first long, _to int, _as int")
        along = numbered.join(F.broadcast(table), F.col("doc_id") == F.col("_first")).select("doc_id", "text", F.col("_to").alias("_range"), F.col("_as").alias("_kind"))
        dealt = dealt.unionByName(along)
    shuffles = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(ranges, max(shuffles, n // _ROWS_OF_TASK)))
    own = F.when(F.col("_range") < ranges, F.floor(F.col("_range").cast("long") * parts / ranges)).otherwise(F.col("_range")).cast("int")
    return dealt.repartitionById(parts, own)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 2_000, most_ranges: int = 65_536) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next of every row.

    Rows follow each other by id, equal ids by text; the last is followed by
    the first, and so is each row without an id.  In a table without any id a
    row follows itself.  Null texts count as empty, a document alone follows
    itself; an empty table gives an empty table; other columns are not read;
    texts of any length count whole, in votes of whole numbers.  Beyond
    ``rows_per_range`` * ``most_ranges`` rows ranges hold more rows each.
    """
    texts = id_and_text(docs, id_col, text_col)
    dealt = _in_ranges(texts, rows_per_range, most_ranges).sortWithinPartitions("_range", "_kind", "doc_id", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, waiting, head = Hasher(), None, None
        for batch in batches:
            pairs: list[tuple[tuple, tuple]] = []
            texts = batch.column(1).to_pylist()
            for key, text, span, kind, own in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), hasher.fingerprints(texts)):
                doc = (span, key, text, own)
                if kind == 0:
                    head = doc
                elif kind == 1 and key is None:
                    pairs.append((doc, head if head and head[0] == span else doc))
                else:
                    if waiting and waiting[0] == span:
                        pairs.append((waiting, doc))
                    waiting = doc if kind == 1 else None
            if pairs:
                yield record(pairs, hasher)

    def record(pairs: list[tuple[tuple, tuple]], hasher: Hasher) -> pa.RecordBatch:
        edited = []
        for (_, _, text, _), (_, _, after, _) in pairs:
            cut = len(text) // 4
            edited.append(text[: len(text) - cut] + after[:cut])
        rows = []
        for ((_, key, text, own), (_, _, _, other)), new, changed in zip(pairs, edited, hasher.fingerprints(edited)):
            rows.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), own.hex(), changed.hex(), likeness(own, changed), likeness(own, other)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return dealt.select("doc_id", "text", "_range", "_kind").mapInArrow(tidy(followed), ", ".join(f"{n} {t}" for n, t in zip(names, ("long", "long", "string", "string", "string", "double", "double"))))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(written(with_next(documents(spark, sf_dir)), "fingerprints"))


QUERIES = {"op8_fingerprints": op8_fingerprints}
ORACLES: dict[str, str] = {}
