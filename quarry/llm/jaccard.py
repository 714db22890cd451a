"""Groups of texts with similar shingle sets, by PartEnum signatures.

Sets whose Jaccard similarity is gamma or more differ in at most
k = (1 - gamma) / gamma * s features, s being the size of the smaller one.  For
each band of sizes the feature domain is cut into n1 parts of n2 cells.  With
n1 * (k2 + 1) > k, n1 - k // (k2 + 1) parts at least hold k2 differences or
fewer; of the cells of such a part n2 - k2 agree.  The signatures of all choices of
n2 - k2 cells, part by part, cannot miss a similar pair (Arasu, Ganti and
Kaushik, 2006).

A signature without a feature says nothing, and unrelated sets would share it.
A set leaves out its empty signatures if fewer of its parts have one than
parts agree in any similar pair: one agreeing part then has none, and the other
set of the pair has the same signatures there.  The rare other sets keep all
signatures, so that two of them meet as well.  ``plan`` chooses n1, n2 and k2
so that these are rare.

Texts with one set are one node.  Only connectedness is asked for, so the nodes
of a signature are first compared with one pivot each, which takes a linear
number of comparisons however large a group of copies is: tasks gather what they have
themselves, buckets gather the tasks' pivots.  Signatures whose nodes are then
not all connected are gathered a second time and all their unconnected pairs
are compared, in blocks of limited size, but for those that a sketch of
parities, as long as the set is large, proves too far apart.  Similarities are
always of the whole sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.pretokens import mixed
from quarry.llm.store import discard, documents, id_and_text, row_of, tidy, written
from quarry.llm.wordhash import Filter, shingle_sets, signed

BAND_RATIO, RARE, ENOUGH = 1.25, 0.002, 8.0
#: Sets and signatures that a task groups at once; signatures in a bucket;
#: members of a pivot compared in one task; rows of a block; nodes whose pairs
#: are listed; bytes of a task.
SETS_AT_ONCE, SIGNATURES_AT_ONCE, BUCKET, MEMBERS, BLOCK, FEW, TASK_BYTES = 60_000, 1_000_000, 1_500_000, 1_000, 2_048, 32, 1 << 26
LEAST_PARITIES = 512
_EMPTY = np.zeros(0, np.uint64)


def sets_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The shingle sets of a column of texts, A-Z in lower case."""
    return shingle_sets([t.lower() for t in column.cast(pa.binary()).to_pylist()], width)


class Names:
    """The number of a set: 63 bits of its 128-bit hash.  Sets that share these
    (some 20 of 2 * 10 ** 10) are told apart by the other bits, and numbered from
    -1 down."""

    def __init__(self, bits: int = 63, aliases: dict[tuple[int, int], int] | None = None):
        self.bits, self.aliases = bits, aliases or {}
        self.shared = {key for key, _ in self.aliases}

    def both(self, features: np.ndarray) -> tuple[int, int]:
        whole = xxhash.xxh3_128_intdigest(features.tobytes())
        return whole >> (128 - self.bits), whole & (1 << 63) - 1

    def __call__(self, features: np.ndarray) -> int:
        key, rest = self.both(features)
        return self.aliases[key, rest] if key in self.shared else key


class Plan(NamedTuple):
    parts: int
    cells: int
    spare: int  # cells of a part that a signature leaves out
    agreeing: int  # parts of a similar pair with at most `spare` differences

    @property
    def choices(self) -> list[list[int]]:
        return [list(c) for c in combinations(range(self.cells), self.cells - self.spare)]


def _at_least(n: int, p: float, k: int) -> float:
    """The chance that k or more of n happen."""
    if p >= 1:
        return 1.0
    logs = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1))
    return min(1.0, sum(map(math.exp, logs)))


@functools.cache
def plan(size: int, differences: int) -> Plan:
    """Parameters for sets of ``size`` features and more: signatures with as many
    features as there can be (up to ENOUGH), if the signatures are fewer than about
    60 % of the features and sets that keep empty ones are rare."""
    best: tuple = ()
    for spare in range(4):
        least = differences // (spare + 1) + 1
        for cells in range(spare + 1, 9):
            choices = math.comb(cells, spare)
            for parts in sorted({math.ceil(least * x) for x in (1, 1.05, 1.1, 1.15, 1.2, 1.25, 1.4, 1.6, 2)}):
                held = (1 - spare / cells) / parts
                agreeing = parts - differences // (spare + 1)
                empty = min(1.0, choices * (1 - held) ** size)
                kept = _at_least(parts, empty, agreeing)
                fits = kept <= RARE and parts * choices <= 0.6 * size + 60
                best = max(best, (fits, min(held * size, ENOUGH) if fits else -kept, -parts * choices, Plan(parts, cells, spare, agreeing)))
    return best[-1]


class Bands:
    """The bands that sets of a size take part in, and their parameters."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.starts = num, den, [1]

    def of(self, size: int) -> list[tuple[int, Plan]]:
        """(band, plan) for each band whose smaller sets a set of this size can resemble."""
        while self.starts[-1] <= size:
            last = self.starts[-1]
            self.starts.append(max(last + 1, int(last * BAND_RATIO)))
        out, band = [], int(np.searchsorted(self.starts, size, side="right")) - 1
        while band >= 0 and self.den * (self.starts[band + 1] - 1) >= self.num * size:
            k = (self.den - self.num) * (self.starts[band + 1] - 1) // self.num
            if k:  # without differences the sets are one node
                out.append((band, plan(self.starts[band], k)))
            band -= 1
        return out


def signatures(features: np.ndarray, bands: Bands) -> np.ndarray:
    out = [_EMPTY]
    again = mixed(features ^ np.uint64(0xA0761D6478BD642F))
    for band, (parts, cells, spare, agreeing) in (found := bands.of(len(features))):
        cell = (features % np.uint64(parts)).astype(np.int64) * cells + (again % np.uint64(cells)).astype(np.int64)
        sums = np.zeros(parts * cells, np.uint64)
        np.add.at(sums, cell, again)
        sums, held = sums.reshape(parts, cells), np.bincount(cell, minlength=parts * cells).reshape(parts, cells) > 0
        all_of_them = np.count_nonzero(held.sum(axis=1) <= spare) >= agreeing
        choices = dict(found)[band].choices
        place = np.arange(parts, dtype=np.uint64) * np.uint64(len(choices)) + (np.uint64(band) << np.uint64(40))
        for k, chosen in enumerate(choices):
            own = mixed(sums[:, chosen].sum(axis=1, dtype=np.uint64) ^ mixed(place + np.uint64(k)))
            out.append(own if all_of_them else own[held[:, chosen].any(axis=1)])
    return np.concatenate(out)


def sketch(features: np.ndarray) -> bytes:
    """Parities, a power of two of them and more than features; two sets differ
    in no fewer features than parities."""
    bits = max(LEAST_PARITIES, 1 << len(features).bit_length())
    bit = (features >> np.uint64(32)) % np.uint64(bits)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=bits) % 2 == 1).tobytes()


def folded(parities: bytes, size: int) -> bytes:
    """The sketch that the same set has with ``size`` bytes."""
    while len(parities) > size:
        half = len(parities) // 2
        parities = (int.from_bytes(parities[:half]) ^ int.from_bytes(parities[half:])).to_bytes(half)
    return parities


def may_link(n: int, a: bytes, m: int, b: bytes, num: int, den: int) -> bool:
    """Whether sets of n and m features with these sketches can be similar."""
    if den * min(n, m) < num * max(n, m):
        return False
    size = min(len(a), len(b))
    far = (int.from_bytes(folded(a, size)) ^ int.from_bytes(folded(b, size))).bit_count()
    return far * (den + num) <= (den - num) * (n + m)


def _sets(rows: DataFrame, width: int, bits: int) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(bits)
        for batch in batches:
            sizes, keys, rest, sketches = [], [], [], []
            for s in sets_of(batch.column(1), width):
                key, other = names.both(s)
                sizes.append(len(s))
                keys.append(key if len(s) else None)
                rest.append(other)
                sketches.append(sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(rest, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "node", "rest", "sketch"])

    return rows.mapInArrow(tidy(made), "doc_id long, n_shingles long, node long, rest long, sketch binary")


def _named(sets: DataFrame, bits: int) -> tuple[DataFrame, Names]:
    """``sets`` with a number of its own for each set, and the numbering."""
    shared = sets.where("node IS NOT NULL").groupBy("node").agg(F.min("rest").alias("a"), F.max("rest").alias("b")).where("a <> b").select("node")
    # Sets that share 63 bits: n * n / 2 ** 64 are to be expected among n sets.
    pairs = sorted(tuple(r) for r in sets.join(shared, "node", "left_semi").select("node", "rest").distinct().collect())
    names = Names(bits, {pair: -1 - i for i, pair in enumerate(pairs)})
    if pairs:
        table = sets.sparkSession.createDataFrame([(*pair, n) for pair, n in names.aliases.items()], "node long, rest long, _alias long")
        sets = sets.join(F.broadcast(table), ["node", "rest"], "left").withColumn("node", F.coalesce("_alias", "node")).drop("_alias")
    return sets, names


def _grouped(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, node) once each, in order, and the group's smallest node."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    keep = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])) if len(sig) else np.zeros(0, bool)
    sig, node = sig[keep], node[keep]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
    return sig, node, np.repeat(node[first], np.diff(np.append(first, len(sig))))


_STAR = ["sig", "pivot", "member"]


def _short(sig: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 32 bits) of signatures.  Signatures that share both are taken
    for one; that adds some 200 pairs to a bucket and loses none."""
    wide = np.uint64(buckets)
    return (sig % wide).astype(np.int64), ((sig // wide) & np.uint64(0xFFFFFFFF))


def _numbered(sig: np.ndarray, buckets: int) -> np.ndarray:
    bucket, low = _short(sig, buckets)
    return (bucket.astype(np.uint64) << np.uint64(32)) | low


def _stars(rows: DataFrame, width: int, names_of: Names, num: int, den: int, buckets: int) -> DataFrame:
    """sig, pivot, member: for each signature of several nodes, enough pairs
    with pivots to connect all of them."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        sigs: list[np.ndarray] = []
        nodes: list[int] = []
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            sig = _numbered(np.concatenate([_EMPTY, *sigs]), buckets)
            node = np.repeat(np.array(nodes, np.int64).view(np.uint64), [len(s) for s in sigs])
            sig, node, pivot = _grouped(sig, node)
            star = node != pivot
            out: list[tuple] = []
            if star.any():
                out.append((0, 1, sig[star].tobytes(), pivot[star].tobytes(), node[star].tobytes()))
            sig, pivot = sig[~star], pivot[~star]
            bucket = (sig >> np.uint64(32)).astype(np.int64)  # in order, as the signatures are
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(sig) else np.zeros(0, np.int64)
            for x, y in zip(first.tolist(), [*first[1:].tolist(), len(sig)]):
                own, index = np.unique(pivot[x:y], return_inverse=True)
                out.append((int(bucket[x]), 0, (sig[x:y] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), index.astype("<u2").tobytes(), own.tobytes()))
            sigs.clear(), nodes.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 5, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "kind", "x", "y", "z"])

        total = 0
        for batch in batches:
            for s in sets_of(batch.column(0), width):
                if not len(s) or (key := names_of(s)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(key)
                sigs.append(signatures(s, bands))
                nodes.append(key)
                total += len(sigs[-1])
                if len(nodes) >= SETS_AT_ONCE or total > SIGNATURES_AT_ONCE:
                    yield flush()
                    total = 0
        yield flush()

    def table(sig: np.ndarray, pivot: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(signed(c)) for c in (sig, pivot, member)], names=_STAR)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: int | None = None
        sigs: list[np.ndarray] = []
        nodes: list[np.ndarray] = []

        def bucket_done() -> pa.RecordBatch:
            sig, node, pivot = _grouped(np.concatenate(sigs), np.concatenate(nodes))
            star = node != pivot
            return table(sig[star], pivot[star], node[star])

        for batch in batches:
            for bucket, kind, x, y, z in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if kind:
                    yield table(*(np.frombuffer(c, np.uint64) for c in (x, y, z)))
                    continue
                if bucket != last and sigs:
                    yield bucket_done()
                    sigs.clear(), nodes.clear()
                last = bucket
                sigs.append(np.frombuffer(x, "<u4").astype(np.uint64) | np.uint64(bucket << 32))
                nodes.append(np.frombuffer(z, np.uint64)[np.frombuffer(y, "<u2")])
        if sigs:
            yield bucket_done()

    blobs = rows.select("text").mapInArrow(tidy(gathered), "bucket int, kind int, x binary, y binary, z binary")
    parts = min(buckets, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // 16)))
    dealt = blobs.repartition(parts, F.when(F.col("kind") == 0, F.col("bucket")).otherwise(F.xxhash64("x"))).sortWithinPartitions("kind", "bucket")
    return dealt.mapInArrow(tidy(met), "sig long, pivot long, member long")


def _links(rows: DataFrame, pairs: DataFrame, reps: DataFrame, width: int, names_of: Names, num: int, den: int, parts: int) -> DataFrame:
    """The ``pairs`` (pivot, member) of nodes that are similar, as (a, b)."""
    # A pivot of very many members is sent to several tasks.
    shares = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / MEMBERS).alias("shares"))
    members = pairs.join(shares, "pivot").select("pivot", F.pmod(F.xxhash64("member"), F.col("shares")).alias("share"), F.col("member").alias("node"))
    pivots = members.select("pivot", "share", F.col("pivot").alias("node")).distinct()
    wanted = members.withColumn("kind", F.lit(1)).unionByName(pivots.withColumn("kind", F.lit(0))).join(reps.where("rep IS NOT NULL"), "node")
    wanted = written(wanted.select("pivot", "share", "node", "kind", "rep"), "needed")
    passes = Filter(wanted, "rep")

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            batch = batch.take(pa.array(np.flatnonzero(passes(ids.view(np.uint64))))) if len(ids) else batch
            out: list[tuple] = []
            for key, text, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets_of(batch.column(1), width)):
                if len(s):
                    out.append((key, names_of(s), text))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 3, (pa.int64(), pa.int64(), pa.string()))], names=["rep", "node", "text"])

    # Repeated rows of a representative come along; they only repeat a link.
    texts = rows.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(tidy(texts_of), "rep long, node long, text string")
    both = wanted.join(texts, ["node", "rep"]).repartition(parts, "pivot", "share").sortWithinPartitions("pivot", "share", "kind")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, _EMPTY
        for batch in batches:
            a, b = [], []
            for pivot, share, node, kind, s in zip(*(batch.column(k).to_pylist() for k in range(4)), sets_of(batch.column(4), width)):
                if kind == 0:
                    at, own = (pivot, share), s
                elif at == (pivot, share):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if den * both >= num * (len(own) + len(s) - both):
                        a.append(pivot)
                        b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return both.select("pivot", "share", "node", "kind", "text").mapInArrow(tidy(compared), "a long, b long")


def _possible(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The ``pairs`` whose sizes and sketches allow them to be similar."""
    own = lambda name: nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))
    both = pairs.join(own("pivot"), "pivot").join(own("member"), "member").where(den * F.least("n_pivot", "n_member") >= num * F.greatest("n_pivot", "n_member"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link(*row, num, den) for row in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            yield batch.select(["pivot", "member"]).filter(pa.array(keep, pa.bool_()))

    return both.select("pivot", "member", "n_pivot", "s_pivot", "n_member", "s_member").mapInArrow(tidy(near), "pivot long, member long")


def _labelled(df: DataFrame, labels: DataFrame, node: str, as_: str) -> DataFrame:
    own = labels.select(F.col("node").alias("_n"), F.col("component").alias(as_))
    return df.join(own, F.col(node) == F.col("_n"), "left").drop("_n").withColumn(as_, F.coalesce(as_, node))


def _open_pairs(rows: DataFrame, open_sigs: DataFrame, labels: DataFrame, nodes: DataFrame, width: int, names_of: Names, num: int, den: int, parts: int, buckets: int, block: int, few: int) -> DataFrame:
    """pivot, member: all pairs of nodes of an open signature that are not yet
    connected and that sizes and sketches allow to be similar.  The pairs of a signature of
    ``few`` nodes or fewer are made distinct before sketches are looked up;
    the nodes of others meet in blocks, with their sketches."""
    wanted = Filter(open_sigs, "sig")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for batch in batches:
            sigs, own = [_EMPTY], []
            for s in sets_of(batch.column(0), width):
                if not len(s) or (key := names_of(s)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(key)
                sig = _numbered(signatures(s, bands), buckets)
                hit = np.unique(sig[wanted(sig)])
                sigs.append(hit)
                own.append(np.full(len(hit), key, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sigs))), pa.array(np.concatenate([_EMPTY.astype(np.int64), *own]))], names=["sig", "node"])

    met = rows.select("text").mapInArrow(tidy(members), "sig long, node long")
    met = written(_labelled(met.join(open_sigs, "sig", "left_semi").distinct(), labels, "node", "component"), "open-members")
    size = met.groupBy("sig").agg(F.count("*").alias("members"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").drop("c0", "c1")
    met = met.join(size, "sig")
    node_rows = F.collect_list(F.struct("node", "component"))  # of at most `few` rows
    later = lambda g, x: F.filter(g, lambda y: (y["node"] > x["node"]) & (y["component"] != x["component"]))
    pairs_of = lambda g: F.flatten(F.transform(g, lambda x: F.transform(later(g, x), lambda y: F.struct(x["node"].alias("pivot"), y["node"].alias("member")))))
    small = met.where(F.col("members") <= few).groupBy("sig").agg(node_rows.alias("g")).select(F.explode(pairs_of(F.col("g"))).alias("pair")).select("pair.*").distinct()
    small = _possible(small, nodes, num, den)
    met = met.where(F.col("members") > few).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(nodes.select("node", "n", "sketch"), "node")
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = met.select("sig", "i", "j", "block", "node", "n", "sketch", "component").repartition(parts, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def done() -> pa.RecordBatch:
            _, i, j = last
            block = np.array([h[0] for h in held])
            node, n, comp = (np.array([h[k] for h in held], np.int64) for k in (1, 2, 4))
            least = min(len(h[3]) for h in held)
            bits = np.frombuffer(b"".join(folded(h[3], least) for h in held), np.uint64).reshape(len(held), -1)
            a, b = [_EMPTY.astype(np.int64)], [_EMPTY.astype(np.int64)]
            for r in range(len(held) - 1):
                x = np.arange(r + 1, len(held))
                x = x[(comp[x] != comp[r]) & ((block[x] != block[r]) if i != j else True)]
                x = x[(den * n[x] >= num * n[r]) & (den * n[r] >= num * n[x])]
                far = np.bitwise_count(bits[x] ^ bits[r]).sum(axis=1, dtype=np.int64)
                x = x[far * (den + num) <= (den - num) * (n[x] + n[r])]
                a.append(np.full(len(x), node[r]))
                b.append(node[x])
            one, two = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["pivot", "member"])

        for batch in batches:
            for sig, i, j, *rest in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if (sig, i, j) != last and held:
                    yield done()
                    held = []
                last = (sig, i, j)
                held.append(tuple(rest))
        if held:
            yield done()

    return dealt.mapInArrow(tidy(paired), "pivot long, member long").unionByName(small).distinct()


def similar_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, block: int = BLOCK, few: int = FEW, key_bits: int = 63, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; texts link when
    den * (size of the intersection) >= num * (size of the union).

    component_id is the smallest doc_id that links lead to.  Null, empty and
    blank texts have no shingles and link with nothing, so they are their own
    component.  A row without an id belongs to the component of its text (null
    if that holds no id).  Repeated rows get a row each; an empty table gives
    an empty table; other columns are not read; texts are whole, however long.
    Sets are numbered by ``key_bits`` bits of their hash where these differ.
    """
    rows = id_and_text(docs, id_col, text_col)
    sets = written(_sets(rows, width, key_bits), "sets")
    sets, names_of = _named(sets, key_bits)
    nodes = sets.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch"))
    nodes = written(nodes, "nodes")
    reps = nodes.select("node", "rep")
    load = nodes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), load * 8 // TASK_BYTES + 1)
    # Sets take part in some two bands with 60 % of their size in signatures.
    buckets = int(max(parts, 1.2 * load // BUCKET + 1))
    link = partial(_links, width=width, names_of=names_of, num=num, den=den, parts=parts)
    stars = written(_stars(rows, width, names_of, num, den, buckets), "stars")
    tried = written(_possible(stars.select("pivot", "member").distinct(), nodes, num, den), "pairs")
    # Each node is first compared with one pivot, then with those that it is not connected with.
    first = written(tried.groupBy("member").agg(F.min("pivot").alias("pivot")).select("pivot", "member"), "first")
    links = written(link(rows, first, reps), "links")
    labels = written(components(links), "labels")
    second = _labelled(_labelled(tried, labels, "pivot", "p"), labels, "member", "m").where("p <> m").select("pivot", "member")
    second = written(second.join(first, ["pivot", "member"], "left_anti"), "second")
    if second.limit(1).count():
        links = links.unionByName(written(link(rows, second, reps), "links"))
        labels = written(components(links), "labels")
    # The one pair of a signature of two nodes has been compared.
    apart = _labelled(_labelled(stars, labels, "pivot", "p"), labels, "member", "m").groupBy("sig").agg(F.count("*").alias("n"), F.bool_or(F.col("p") != F.col("m")).alias("apart"))
    open_sigs = written(apart.where("apart AND n > 1").select("sig"), "open")
    discard(stars, first, second)
    if open_sigs.limit(1).count():
        rest = _open_pairs(rows, open_sigs, labels, nodes, width, names_of, num, den, parts, buckets, block, few)
        same: list[Column] = [F.col("t.pivot") == F.col("r.pivot"), F.col("t.member") == F.col("r.member")]
        rest = written(rest.alias("r").join(tried.alias("t"), same, "left_anti"), "rest")
        more = written(link(rows, rest, reps), "links")
        if more.limit(1).count():
            labels = written(components(links.unionByName(more)), "labels")
        discard(rest, more)
    named = written(_labelled(reps, labels, "node", "component"), "named")
    discard(nodes, tried, open_sigs, labels)
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "component").select(F.col("node").alias("_node"), "component_id")
    out = sets.join(named, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, and rows
    without an id, with all columns as they are.

    Null, empty and blank texts are groups of their own and stay; of repeated
    rows of the smallest id all stay; an empty table gives an empty table;
    texts of any length are compared whole.
    """
    others = similar_groups(docs, width, num, den, id_col=id_col, text_col=text_col).where("component_id <> doc_id").select(F.col("doc_id").alias("_other")).distinct()
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("_id"), row_of(docs).alias("_row"))
    rows = rows.join(written(others, "others"), F.col("_id") == F.col("_other"), "left_anti")
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir), width=3, num=90, den=100)


QUERIES = {"op7_jaccard": op7_jaccard}
ORACLES: dict[str, str] = {}
