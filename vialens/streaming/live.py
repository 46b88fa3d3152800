"""The live engine: fixes in, vehicle states out. ``cycle`` publishes them, ``timed`` adds timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vialens.constants import DEDUPE_S, DROP_S
from vialens.operators import processor
from vialens.operators.processor import STATE, Network, Tracker, state_row


def track(fixes: DataFrame, net: Network, timeouts: bool = False) -> DataFrame:
    """Each vehicle's state after each micro-batch of ``fixes``; the state lives in Spark's state store.

    Fixes of a batch are applied in the order of arrival. With ``timeouts``, a vehicle that has been silent for 300 s of
    processing time is forgotten.
    """
    mode = GroupStateTimeout.ProcessingTimeTimeout if timeouts else GroupStateTimeout.NoTimeout
    names = fixes.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        k = Tracker.load(net, state.get[0]) if state.exists else Tracker(net)
        rows = [processor._clean(r) for b in batches for r in b.to_dict("records")]
        for fix in sorted(rows, key=lambda f: (f["seen_at"], f["t"])):
            k.tick(fix["seen_at"])
            k.step(fix, fix["seen_at"])
        state.update((k.dump(),))
        if timeouts:
            state.setTimeoutDuration(DROP_S * 1000)
        row = state_row(key[0], k)
        yield processor._frame([row] if row else [], STATE)

    return fixes.select(*names).groupBy("vehicle").applyInPandasWithState(step, STATE, "payload string", "update", mode)


def deduplicated(fixes: DataFrame) -> DataFrame:
    """Fixes of a stream without repeats of a report within ten minutes of arrival."""
    return fixes.withColumn("arrived", F.timestamp_seconds("seen_at")).withWatermark("arrived", f"{DEDUPE_S} seconds").dropDuplicatesWithinWatermark(["vehicle", "vendor", "t"]).drop("arrived")
