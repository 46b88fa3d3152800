"""Vehicle states with timers: a vehicle that falls silent is reported as stale, and later as gone, without another fix."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vialens import constants as C
from vialens.operators import processor
from vialens.operators.processor import STATE, Network, Tracker, Vehicle, state_row
from vialens.streaming.cycle import GONE

#: What a session needs for ``track``: state of several variables lies in RocksDB.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class VehicleProcessor(StatefulProcessor):
    """One vehicle: its state, the reports of the last ten minutes one by one, and how many found no route.

    Timers stand at 180 and 300 s after the last accepted fix. The first gives a row with phase ``stale``, the second one with
    phase ``gone`` and forgets the vehicle. Reports expire by themselves.
    """

    def __init__(self, net: Network):
        self.net = net

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.vehicle = handle.getValueState("vehicle", "payload string")
        self.unmatched = handle.getValueState("unmatched", "n long")
        self.seen = handle.getMapState("seen", "report string", "at long", ttlDurationMs=C.DEDUPE_S * 1000)

    def _row(self, key: tuple, k: Tracker) -> pd.DataFrame:
        row = state_row(key[0], k)
        return processor._frame([row] if row else [], STATE)

    def _gone(self, key: tuple, t: int) -> pd.DataFrame:
        return processor._frame([{"vehicle": key[0], "t": t, "phase": GONE}], STATE)

    def _held(self) -> Tracker:
        k = Tracker(self.net, unmatched=self.unmatched.get()[0] if self.unmatched.exists() else 0)
        if self.vehicle.exists():
            k.vehicle = Vehicle.load(self.vehicle.get()[0])
        return k

    def _keep(self, k: Tracker) -> None:
        if k.vehicle is None:
            self.vehicle.clear()
        else:
            self.vehicle.update((k.vehicle.dump(),))
        self.unmatched.update((k.unmatched,))

    def _set_timers(self, k: Tracker) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if k.vehicle and k.vehicle.t:
            for s in (C.STALE_S, C.DROP_S):
                self.handle.registerTimer((k.vehicle.t + s + 1) * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        k = self._held()
        was = k.vehicle
        fixes = sorted((processor._clean(r) for b in rows for r in b.to_dict("records")), key=lambda f: (f["seen_at"], f["t"]))
        for fix in fixes:
            report = (f"{fix['vendor']}|{fix['t']}",)
            if self.seen.containsKey(report):  # only the reports that these fixes name are read
                k.seen[report[0]] = self.seen.getValue(report)[0]
        before = dict(k.seen)
        for fix in fixes:
            k.tick(fix["seen_at"])
            k.step(fix, fix["seen_at"])
        for report, at in k.seen.items():
            if before.get(report) != at:
                self.seen.updateValue((report,), (at,))
        self._keep(k)
        self._set_timers(k)
        if k.vehicle is None and was is not None:
            yield self._gone(key, was.t)
        else:
            yield self._row(key, k)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        k = self._held()
        v = k.vehicle
        if v is None:
            return
        if expiredTimerInfo.getExpiryTimeInMs() > (v.t + C.DROP_S) * 1000:
            self.vehicle.clear()
            self.unmatched.clear()
            yield self._gone(key, v.t)
        elif v.phase != "stale":
            v.phase = "stale"
            self._keep(k)
            yield self._row(key, k)

    def close(self) -> None:
        pass


def track(fixes: DataFrame, net: Network) -> DataFrame:
    """Each vehicle's state after each micro-batch of a stream of ``fixes``, and when it turns stale or goes by the clock."""
    return fixes.groupBy("vehicle").transformWithStateInPandas(statefulProcessor=VehicleProcessor(net), outputStructType=STATE, outputMode="update", timeMode="processingTime")
