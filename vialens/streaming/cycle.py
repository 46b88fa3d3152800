"""The publishing cycle: a batch's states are merged into the fleet's table, and one snapshot of it is fanned out to documents."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vialens import constants as C
from vialens.operators import documents, views
from vialens.operators.processor import STATE
from vialens.sources.files import write_documents
from vialens.streaming.keyed import KeyedTable

GONE = "gone"


def aged(states: DataFrame, now: int) -> DataFrame:
    """States as they are at a clock: stale after 180 s without a fix, left out after 300 s."""
    silent = F.lit(now) - F.col("t")
    return states.where(silent <= C.DROP_S).withColumn("phase", F.when(silent > C.STALE_S, "stale").otherwise(F.col("phase")))


class Cycle:
    """A sink for ``foreachBatch``: states in, documents out. Both tables and the documents lie under ``root``.

    ``shapes`` and ``stops`` are dimensions as in ``views``, ``stops`` with lat and lon; ``lines`` are the known lines (``line``).
    A batch that is handed over again changes nothing. ``clock`` gives the time at which a snapshot is aged.
    """

    def __init__(self, spark: SparkSession, root: str, shapes: DataFrame, stops: DataFrame, lines: DataFrame, zoom: int = 11, version: str = "", clock: Callable[[], int] = lambda: int(time.time())):
        self.root, self.shapes, self.stops, self.lines = root.rstrip("/"), shapes, stops, lines
        self.zoom, self.version, self.clock = zoom, version, clock
        self.states = KeyedTable(spark, f"{self.root}/tables/states", ["vehicle"], STATE)
        self.published = KeyedTable(spark, f"{self.root}/tables/published", ["path"], "path string, digest string, size long")
        self.last: dict[str, int] = {}

    def documents(self, now: int) -> DataFrame:
        """All documents of the fleet's table as it is now."""
        states = aged(self.states.read(), now)
        snapshot, arrivals = views.snapshot(states, self.shapes, self.stops), views.arrivals(states, self.shapes, self.stops)
        parts = [
            documents.line_documents(snapshot, self.lines),
            documents.cell_documents(snapshot, self.zoom),
            documents.arrival_documents(arrivals, self.stops, self.zoom),
            documents.fleet_document(snapshot),
            documents.live_lines_document(snapshot, self.lines),
            documents.index_document(snapshot, arrivals, views.phase_counts(states), views.pending_reasons(states), now, self.zoom, self.version),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def __call__(self, batch: DataFrame, number: int) -> None:
        now = self.clock()
        self.states.merge(batch, number, newest=["t", "accepted"], gone=(F.col("phase") == GONE) | (F.lit(now) - F.col("t") > C.DROP_S))
        self.last = write_documents(self.documents(now), f"{self.root}/public", self.published, number)


def start(states: DataFrame, cycle: Cycle, checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Publishes a stream of states every ten seconds. With timers in the stream a cycle runs also when nothing has come in."""
    return states.writeStream.outputMode("update").foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
