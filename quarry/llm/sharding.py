"""Shards by a k-d tree over the metadata of documents.

The points of the tree are the distinct texts, each with the bytes of all its
rows, so that equal texts stay together.  Every node is split along its widest dimension (language, source or size,
as a share of that dimension's range over the whole table) at the weighted median
of bytes, until leaves reach the target.  All nodes of a level are split
together.  A median is found exactly by radix selection over 48-bit keys (16
bits of the dimension, then 32 of the text's hash): four
grouped sums over narrow rows, of which at most one row a node goes to the driver.
The text on the median goes to the side that makes the halves more equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.store import block_no, documents, literal_rows, written

DIMENSIONS = ("lang", "source", "size")
_DIGIT, _DIGITS = 12, 4


def _text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    text = docs[f"`{text_col}`"].cast("string")
    named = {"lang": docs[f"`{lang_col}`"], "source": docs[f"`{source_col}`"]}
    return docs.select(
        docs[f"`{id_col}`"].cast("long").alias("doc_id"),
        _text_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        # 128 bits stand for the text; a null text is one with the empty text.
        F.md5(F.coalesce(text, F.lit(""))).alias("text"),
        *[c.cast("string").alias(n) for n, c in named.items()],
    )


def _points(rows: DataFrame) -> DataFrame:
    """text, bytes, _at, _tie of every distinct text: its place in each
    dimension (the smallest language and source of its rows count), and its order
    among texts of one place."""
    code = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 16))
    points = rows.groupBy("text").agg(F.sum("size").alias("bytes"), F.max("size").alias("size"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    length = F.least(F.floor(F.log2("size") * 1024), F.lit((1 << 16) - 1)).cast("long")
    return points.select("text", "bytes", F.array(code("lang"), code("source"), length).alias("_at"), F.conv(F.substring("text", 1, 8), 16, 10).cast("long").alias("_tie"))


def _split(spark: SparkSession, points: DataFrame, nodes: dict[int, int], ranges: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """node: (dimension, largest key of the left half) of the given nodes, each
    of which is to become nodes[n] leaves."""
    here = points.join(F.broadcast(literal_rows(spark, [(n,) for n in nodes], "_node int")), "_node")
    k = range(len(DIMENSIONS))
    stats = here.groupBy("_node").agg(F.sum("bytes").alias("bytes"), *[f(F.get("_at", F.lit(d))).alias(f"{f.__name__}{d}") for d in k for f in (F.min, F.max)]).collect()  # one row a node
    state, wanted = {}, {}
    for s in stats:
        width = [(s[f"max{d}"] - s[f"min{d}"]) / max(1, ranges[d][1] - ranges[d][0]) for d in k]
        m = nodes[s["_node"]]
        wanted[s["_node"]] = s["bytes"] * (m // 2) / m, s["bytes"]
        state[s["_node"]] = (width.index(max(width)), 0, wanted[s["_node"]][0])
    for digit in range(_DIGITS):
        low = _DIGIT * (_DIGITS - 1 - digit)
        at = F.broadcast(literal_rows(spark, [(n, *x) for n, x in state.items()], "_node int, _dim int, _prefix long, _need double"))
        keyed = points.join(at, "_node").withColumn("_key", F.get("_at", F.col("_dim")) * (1 << 32) + F.col("_tie"))
        keyed = keyed.where(F.shiftright("_key", low + _DIGIT) == F.col("_prefix"))
        sums = keyed.groupBy("_node", "_need", F.shiftright("_key", low).alias("_bin")).agg(F.sum("bytes").alias("_w"))
        order = Window.partitionBy("_node").orderBy("_bin")  # at most 2 ** 12 rows a node
        sums = sums.withColumn("_sum", F.sum("_w").over(order)).withColumn("_last", F.row_number().over(Window.partitionBy("_node").orderBy(F.desc("_bin"))) == 1)
        crossing = sums.where(((F.col("_sum") >= F.col("_need")) | F.col("_last")) & (F.col("_sum") - F.col("_w") < F.col("_need")))
        for c in crossing.collect():  # one row a node
            state[c["_node"]] = (state[c["_node"]][0], c["_bin"], c["_need"] - (c["_sum"] - c["_w"]), c["_w"])
        state = {n: x[: 3 if digit < _DIGITS - 1 else 4] for n, x in state.items()}
    out = {}
    for n, (d, key, need, weight) in state.items():
        before = wanted[n][0] - need  # what lies left of the text on the median
        to_right = before > 0 and (need < weight - need or before + weight >= wanted[n][1])
        out[n] = (d, key - 1 if to_right else key)
    return out


def shard(docs: DataFrame, target_bytes: int | None = None, shards: int | None = None, rows_per_block: int = 50_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row, in as many leaves
    as ``target_bytes`` asks for, or in ``shards`` of nearly equal bytes.

    Rows of equal texts (null counts as empty) are in one shard, so that a
    shard can exceed its share by less than the rows of one text.  Null or empty texts have
    size 1; null languages, sources and ids are values like any other; repeated
    rows take a slot each; with fewer distinct texts than shards some shards stay empty;
    an empty table gives an empty table; texts of any length are
    whole; other columns are not read.
    """
    spark = docs.sparkSession
    rows = written(_rows(docs, id_col, text_col, lang_col, source_col), "rows")
    points = written(_points(rows), "points")
    k = range(len(DIMENSIONS))
    root = points.agg(F.sum("bytes").alias("bytes"), *[f(F.get("_at", F.lit(d))).alias(f"{f.__name__}{d}") for d in k for f in (F.min, F.max)]).first()
    leaves = shards or max(1, -(-(root["bytes"] or 0) // target_bytes))
    ranges = [(root[f"min{d}"] or 0, root[f"max{d}"] or 0) for d in k]
    points = points.withColumn("_node", F.least(F.col("bytes"), F.lit(0)).cast("int"))  # 0 (sizes are 1 and more), but no constant
    # A node's number is the first of its shards, so that leaves are numbered as they lie.
    open_nodes = {0: leaves} if root["bytes"] else {}
    while open_nodes := {n: m for n, m in open_nodes.items() if m > 1}:
        cuts = _split(spark, points, open_nodes, ranges)
        step = [(n, d, key, n + m // 2) for n, m in open_nodes.items() if n in cuts for d, key in [cuts[n]]]
        at = F.broadcast(literal_rows(spark, step, "_node int, _dim int, _cut long, _right int"))
        key = F.get("_at", F.col("_dim")) * (1 << 32) + F.col("_tie")
        points = points.join(at, "_node", "left").withColumn("_node", F.when(key > F.col("_cut"), F.col("_right")).otherwise(F.col("_node"))).drop("_dim", "_cut", "_right")
        open_nodes = {a: b for n, m in open_nodes.items() for a, b in ((n, m // 2), (n + m // 2, m - m // 2))}
    # Hot texts: their rows are spread by the join's skew handling, and by blocks below.
    placed = rows.join(points.select("text", F.col("_node").alias("shard")), "text")
    n = max(1, -(-rows.count() // rows_per_block))
    blocks = written(placed.withColumn("_block", block_no(n, F.col("doc_id"), F.col("text"))), "placed")
    base = blocks.groupBy(F.col("shard").alias("_s"), F.col("_block").alias("_b")).agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("_s", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("shard", "_block").orderBy("doc_id", "text")
    numbered = blocks.withColumn("_rank", F.row_number().over(own) - 1).join(base, (F.col("shard") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("_base") + F.col("_rank")).cast("long").alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    out = shard(docs, shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_sharding": op10_sharding}
ORACLES: dict[str, str] = {}
