"""Repeated passages by super-k-mer partitioning.

A window of 50 words has a minimiser, the smallest hash of the 16-word grams in
it.  Consecutive windows with one minimiser travel as one packed string (a
super-k-mer) to the bucket of their minimiser, so all occurrences of a window
meet there; sorting ranks the windows of a bucket exactly, word for word.

Only minimisers met in two documents or more can hold a repeated window.  They
are found by a first, narrow aggregation and go into a bitmap
that every task filters by, or are joined to their documents where they are too many for one.  Equal super-k-mers are joined to one with their
smallest document before they move to the buckets, and a minimiser with very
many different strings is dealt out by window instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarry.llm.store import documents, id_and_text, row_of, tidy, written
from quarry.llm.wordhash import MOST_BITS, Filter, hashed_texts, signed, sliding_min, window_hashes

WINDOW, GRAM = 50, 16
#: Windows of one super-k-mer; different strings of a minimiser that one task
#: sorts; words that a task sorts at once; bytes of strings in a task.
MOST_WINDOWS, HOT_STRINGS, WORDS_AT_ONCE, TASK_BYTES = 256, 1_000, 300_000, 1 << 26


def super_kmers(hashes: np.ndarray, width: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of the super-k-mers of a text's word hashes."""
    if len(hashes) < width:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    least = sliding_min(window_hashes(hashes, gram), width - gram + 1)
    n = len(least)
    new = np.append(True, least[1:] != least[:-1])
    at = np.flatnonzero(new)
    since = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    first = np.flatnonzero(since % MOST_WINDOWS == 0)
    return least[first], first, np.diff(np.append(first, n))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of one id and one text are alike in all that follows."""
    return id_and_text(docs, id_col, text_col).withColumn("_t", F.xxhash64("text"))


def _met(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """minimiser, doc_id of every document's minimisers."""

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for key, hashes in zip(batch.column(0).to_pylist(), hashed_texts(batch.column(1).cast(pa.binary()).to_pylist())):
                found = np.unique(super_kmers(hashes, width, gram)[0])
                out.append(found)
                ids.append(np.full(len(found), key, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(out))), pa.array(np.concatenate(ids))], names=["minimiser", "doc_id"])

    return rows.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(tidy(minimisers), "minimiser long, doc_id long")


def _packed(rows: DataFrame, width: int, gram: int, filter_bits: int) -> DataFrame:
    """doc_id, _t, minimiser, first, packed of super-k-mers that may repeat.

    Minimisers of two documents or more are looked up in a bitmap; where they
    are too many for ``filter_bits``, each document is joined with its own."""
    met = _met(rows, width, gram)
    both = met.groupBy("minimiser").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    several = written(both.select("minimiser"), "repeated")
    repeated = Filter(several, "minimiser", filter_bits)
    rows = rows.where("doc_id IS NOT NULL").select("doc_id", "text", "_t")
    if exact := repeated.passes_all:
        own = met.join(several, "minimiser", "left_semi").groupBy("doc_id").agg(F.collect_set("minimiser").alias("own"))
        rows = rows.join(own, "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for i, (key, text, t, hashes) in enumerate(zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), hashed_texts(texts))):
                least, first, n = super_kmers(hashes, width, gram)
                if not len(least):
                    continue
                keep = np.flatnonzero(np.isin(signed(least), batch.column(3)[i].values.to_numpy()) if exact else repeated(least))
                words = text.split() if len(keep) else []
                for m, a, k in zip(signed(least[keep]).tolist(), first[keep].tolist(), n[keep].tolist()):
                    for column, value in zip(out, (key, t, m, a, b" ".join(words[a : a + k + width - 1]))):
                        column.append(value)
                if sum(map(len, out[4][-512:])) > 1 << 22 or len(out[0]) > 20_000:
                    yield record(out)
                    out = [[], [], [], [], []]
            yield record(out)

    def record(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "_t", "minimiser", "first", "packed"])

    return rows.mapInArrow(tidy(cut), "doc_id long, _t long, minimiser long, first int, packed binary")


def window_ranks(words: np.ndarray, width: int) -> np.ndarray:
    """Equal numbers for equal windows of ``width`` word numbers, by ranks of
    windows of 1, 2, 4, ... words; words past the end count as -1."""
    rank, span = words, 1

    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        top = int(max(a.max(initial=0), b.max(initial=0))) + 2
        return np.unique((a + 1) * top + (b + 1), return_inverse=True)[1]

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        return np.append(x[by:], np.full(min(by, len(x)), -1))

    while span * 2 <= width:
        rank, span = pairs(rank, shifted(rank, span)), span * 2
    return pairs(rank, shifted(rank, width - span)) if span < width else rank


def first_documents(strings: list[bytes], docs: list[int], width: int) -> list[list[tuple[int, int, int]]]:
    """(window, windows, smallest document with these) runs of each string."""
    numbers: dict[bytes, int] = {}
    sizes, flat = [], []
    for s in strings:
        words = s.split(b" ")
        sizes.append(len(words))
        flat += [numbers.setdefault(w, len(numbers)) for w in words]
    size = np.array(sizes, np.int64)
    start = np.cumsum(size) - size
    rank = window_ranks(np.array(flat, np.int64), width)
    count = size - width + 1
    at = np.repeat(start, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    ranks, owner = rank[at], np.repeat(np.arange(len(strings)), count)
    doc = np.array(docs, np.int64)[owner]
    least = np.full(int(ranks.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, ranks, doc)
    found = least[ranks]
    new = np.flatnonzero(np.append(True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])))
    length = np.diff(np.append(new, len(found)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in strings]
    offset = new - (np.cumsum(count) - count)[owner[new]]
    for o, a, n, d in zip(owner[new].tolist(), offset.tolist(), length.tolist(), found[new].tolist()):
        out[o].append((a, n, d))
    return out


_RUNS = "_p1 long, _p2 long, at int, n int, smallest long"
_RUN_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
_RUN_NAMES = ["_p1", "_p2", "at", "n", "smallest"]


def _in_buckets(strings: DataFrame, width: int, parts: int) -> DataFrame:
    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def done() -> pa.RecordBatch:
            found = first_documents([h[0] for h in held], [h[1] for h in held], width)
            rows = [(p1, p2, *run) for (_, _, p1, p2), runs in zip(held, found) for run in runs]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _RUN_TYPES)], names=_RUN_NAMES)

        for batch in batches:
            for m, s, doc, p1, p2 in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if m != last and size > WORDS_AT_ONCE:
                    yield done()
                    held, size = [], 0
                held.append((s, doc, p1, p2))
                size, last = size + s.count(b" ") + 1, m
        if held:
            yield done()

    dealt = strings.repartition(parts, "minimiser").sortWithinPartitions("minimiser")
    return dealt.select("minimiser", "packed", "smallest", "_p1", "_p2").mapInArrow(tidy(ranked), _RUNS)


def _by_window(strings: DataFrame, width: int) -> DataFrame:
    """The same for minimisers with very many strings: a row for each window."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s, doc, p1, p2 in zip(*(batch.column(k).to_pylist() for k in range(4))):
                words = s.split(b" ")
                for a in range(len(words) - width + 1):
                    h = xxhash.xxh3_128_digest(b" ".join(words[a : a + width]))
                    rows.append((h, doc, p1, p2, a))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["h", "doc", "_p1", "_p2", "at"])

    each = strings.select("packed", "smallest", "_p1", "_p2").mapInArrow(tidy(windows), "h binary, doc long, _p1 long, _p2 long, at int")
    least = each.groupBy("h").agg(F.min("doc").alias("smallest"))
    return each.join(least, "h").select("_p1", "_p2", "at", F.lit(1).alias("n"), "smallest")


def repeats(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, hot_strings: int = HOT_STRINGS, filter_bits: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _t, runs: the runs (window, windows) of each id and text whose
    words also start in a document with a smaller id."""
    rows = _keyed(docs, id_col, text_col)
    packed = _packed(rows, width, gram, filter_bits)
    packed = written(packed.withColumns({"_p1": F.xxhash64("minimiser", "packed"), "_p2": F.xxhash64("packed", "minimiser")}), "super-kmers")
    # Equal strings count once, with their smallest document, from each task on.
    strings = written(packed.groupBy("minimiser", "packed", "_p1", "_p2").agg(F.min("doc_id").alias("smallest")), "strings")
    hot = written(strings.groupBy("minimiser").agg(F.count("*").alias("c")).where(F.col("c") > hot_strings).select("minimiser"), "hot")
    size = strings.agg(F.sum(F.length("packed"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES + 1)
    runs = _in_buckets(strings.join(hot, "minimiser", "left_anti"), width, parts)
    if hot.limit(1).count():
        runs = runs.unionByName(_by_window(strings.join(hot, "minimiser", "left_semi"), width))
    members = packed.select("doc_id", "_t", "first", "_p1", "_p2").join(runs, ["_p1", "_p2"]).where(F.col("smallest") < F.col("doc_id"))
    run = F.struct((F.col("first") + F.col("at")).alias("a"), F.col("n"))
    return members.groupBy("doc_id", "_t").agg(F.collect_set(run).alias("runs"))


def without_repeats(
    docs: DataFrame,
    digest: bool = False,
    width: int = WINDOW,
    gram: int = GRAM,
    hot_strings: int = HOT_STRINGS,
    filter_bits: int = MOST_BITS,
    counts: bool = True,
    keep_emptied: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with the words of repeated windows taken out of the text, and
    with ``counts`` n_words and n_removed, which replace columns of these names; with
    ``digest`` only doc_id, n_words, n_removed and kept_sha256.

    A text that loses words is the rest joined by blanks; a text that loses
    none stays as it is.  Null texts have no words and stay null; rows without
    an id neither lose words nor make others lose them; rows of one id do not
    repeat each other; an empty table gives an empty table; other columns,
    whatever their names, stay as they are; texts of any length are whole.
    Without ``keep_emptied`` rows that lose all their words go.
    """
    found = repeats(docs, width, gram, hot_strings, filter_bits, id_col, text_col).select(F.col("doc_id").alias("_k2"), F.col("_t").alias("_t2"), F.col("runs").alias("_runs"))
    new = ("n_words", "n_removed") if counts else ()
    others = [c for c in docs.columns if c not in (*new, text_col)]
    text = docs[f"`{text_col}`"].cast("string")
    carried = [docs[f"`{id_col}`"].cast("long").alias("_row")] if digest else [row_of(docs, (*new, text_col)).alias("_row")] if others else []
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("_k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_t"), text.alias("_text"), *carried)
    joined = rows.join(found, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_t") == F.col("_t2")), "left").select("_text", "_runs", *(["_row"] if carried else []))

    with_row = bool(carried)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed, digests = [], [], [], []
            for text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode().split()
                kept = words
                if runs:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for r in runs:
                        gone[r["a"]] += 1
                        gone[r["a"] + r["n"] + width - 1] -= 1
                    gone = np.cumsum(gone)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                if digest:
                    digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                else:
                    texts.append(text if len(kept) == len(words) else b" ".join(kept).decode())
            columns = [pa.array(digests if digest else texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), *([batch.column(2)] if with_row else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["new", "n_words", "n_removed", *(["row"] if with_row else [])])

    fields = [StructField("new", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())]
    done = joined.mapInArrow(tidy(cut), StructType(fields + ([StructField("row", joined.schema["_row"].dataType)] if with_row else [])))
    if digest:
        return done.select(F.col("row").alias("doc_id"), "n_words", "n_removed", F.col("new").alias("kept_sha256"))
    if not keep_emptied:
        done = done.where("n_removed = 0 OR n_removed < n_words")
    kind = docs.schema[text_col].dataType
    return done.select(*[(F.col("new").cast(kind) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in new], *new)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir), digest=True)


QUERIES = {"op6_substrings": op6_substrings}
ORACLES: dict[str, str] = {}
