"""Tables that cut a plan's lineage, kept where every executor can read them.

A long job survives the loss of executors if what it has worked out lies in
the shared folder that the cluster names in ``spark.checkpoint.dir``.  Only
where that setting is absent (tests, a laptop) is a temporary folder used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None
_paths: dict[int, str] = {}


def shared_folder(spark: SparkSession) -> str:
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster names the folder that its executors share in spark.checkpoint.dir")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, _own_folder, True)
    return f"file://{_own_folder}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` after one pass, as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[id(table)] = path
    weakref.finalize(table, _paths.pop, id(table), None)
    return table


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for table in tables:
        if path := _paths.get(id(table)):
            jvm = table.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
