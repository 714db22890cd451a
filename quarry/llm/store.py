"""What the operators share: their input columns, blocks, and written tables."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.store import discard, shared_folder, written

__all__ = ["block_no", "discard", "documents", "id_and_text", "let", "literal_rows", "row_of", "shared_folder", "slices", "tidy", "written"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on; whatever else the table holds,
    under whatever name, cannot clash with the operator's own columns."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def row_of(docs: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns of ``docs`` as one struct, so that an operator can carry them
    along under names that clash with none of its own."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns if c not in without])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def block_no(n: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of numbers made by the JVM alone, for native operators."""
    fields = [f.split() for f in schema.split(",")]
    values = ", ".join("(" + ", ".join(f"CAST({v!r} AS {kind})" for v, (_, kind) in zip(row, fields)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(name for name, _ in fields)})")


def slices(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of some ``most`` bytes, a row or more each."""
    rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], most: int = 4_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over small slices; what it has freed goes back to the system
    when it ends, as the next task of the worker may be of another kind."""

    @functools.wraps(work)
    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(part for batch in batches for part in slices(batch, most))
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # not this C library
                pass

    return worked
