"""Health of providers from their events, in batch.

Events have engine, ts, success, hard_block, latency_ms and a tie-break id.
A success ends a streak of failures and any quarantine; a hard block, or the
third failure of a streak and each further one, quarantines for ten minutes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA, SEED_MS, STREAK, QUARANTINE_S = 0.2, 500.0, 3, 600


def timeline(events: DataFrame, id_col: str = "event_id") -> DataFrame:
    """``events`` with failures (streak so far) and quarantined_until after each."""
    order = Window.partitionBy("engine").orderBy("ts", id_col)
    island = F.sum(F.col("success").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    own = Window.partitionBy("engine", "_island").orderBy("ts", id_col)
    streaks = events.withColumn("_island", island).withColumn("failures", F.sum((~F.col("success")).cast("int")).over(own))
    until = F.when(~F.col("success") & (F.col("hard_block") | (F.col("failures") >= STREAK)), F.col("ts") + F.expr(f"INTERVAL {QUARANTINE_S} SECONDS"))
    return streaks.withColumn("quarantined_until", F.last(until, True).over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_island")


def _ewma(latencies: Column) -> Column:
    return F.aggregate(latencies, F.lit(SEED_MS), lambda a, x: (1 - ALPHA) * a + ALPHA * x)


def latency(events: DataFrame, id_col: str = "event_id", keep: int = 256) -> DataFrame:
    """engine, ewma_ms: from the last ``keep`` successes; what came before them
    weighs 0.8 ** keep (1e-25 for 256), less than a double tells apart."""
    good = events.where("success")
    rank = F.row_number().over(Window.partitionBy("engine").orderBy(F.desc("ts"), F.desc(id_col)))
    last = good.withColumn("_r", rank).where(F.col("_r") <= keep)
    seen = last.groupBy("engine").agg(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), "latency_ms"))).alias("_l"))
    return seen.select("engine", _ewma(F.transform("_l", lambda x: x["latency_ms"])).alias("ewma_ms"))


def snapshot(events: DataFrame, now: Column, id_col: str = "event_id") -> DataFrame:
    """One row an engine: its state after all events, and whether ``now`` is
    within its quarantine."""
    last = F.row_number().over(Window.partitionBy("engine").orderBy(F.desc("ts"), F.desc(id_col)))
    final = timeline(events, id_col).withColumn("_r", last).where("_r = 1")
    totals = events.groupBy("engine").agg(F.count_if("success").alias("total_successes"), F.count_if(~F.col("success")).alias("total_failures"))
    state = final.select("engine", F.col("failures").alias("consecutive_failures"), "quarantined_until").join(totals, "engine").join(latency(events, id_col), "engine", "left")
    return state.withColumns({"ewma_ms": F.coalesce("ewma_ms", F.lit(SEED_MS)), "quarantined": F.coalesce(now < F.col("quarantined_until"), F.lit(False))})
