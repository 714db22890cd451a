"""Health of providers as a stream: one row of state for each provider.

The state is a record of fixed size in Spark's state store, so a restarted
query goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators.health import ALPHA, QUARANTINE_S, SEED_MS, STREAK

_STATE = "ewma_ms double, failures int, until timestamp, successes long, total_failures long"
_OUT = "engine string, ewma_ms double, consecutive_failures int, quarantined_until timestamp, total_successes long, total_failures long"


def tracked(events: DataFrame) -> DataFrame:
    """For each batch, the new state of every engine that had events (engine,
    ts, event_id, success, hard_block, latency_ms), taken in order of time."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ewma, failures, until, good, bad = state.get if state.exists else (SEED_MS, 0, None, 0, 0)
        for e in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            if e.success:
                ewma, failures, until, good = (1 - ALPHA) * ewma + ALPHA * e.latency_ms, 0, None, good + 1
            else:
                failures, bad = failures + 1, bad + 1
                if e.hard_block or failures >= STREAK:
                    until = e.ts + pd.Timedelta(seconds=QUARANTINE_S)
        state.update((ewma, failures, until, good, bad))
        yield pd.DataFrame({"engine": [key[0]], "ewma_ms": [ewma], "consecutive_failures": [failures], "quarantined_until": [until], "total_successes": [good], "total_failures": [bad]})

    return events.groupBy("engine").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
