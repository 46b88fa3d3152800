"""The feeds as streams: minutes of the aggregator read page by page on a schedule, and polls of the binary feed.

An offset counts read slots. Five times a minute a slot comes up: four read the minute that is open, one the minute that has just
closed. A stream that has fallen behind reads all closed minutes that it missed, and of the open ones only the newest. What could
not be fetched is a row too, with its error; a closed minute that stays incomplete after the retries is taken as it is and flagged.
"""

from __future__ import annotations

import datetime
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQueryListener

# Seconds into a minute at which the feed is read, and which of them reads the closed minute.
SLOTS, CLOSED = [8, 18, 23, 38, 53], 18
# Rows a page, pages a read, retries of an incomplete closed minute, seconds between them, the second that a
# complete minute reaches, its share of the usual rows, and seconds between two polls of the binary feed.
LIMIT, MAX_PAGES, RETRIES, RETRY_S, LAST_SECOND, SHARE, POLL_S = 5000, 8, 3, 5.0, 45, 0.6, 30
SCHEMA = "minute string, page int, value string, rows int, complete boolean, warming boolean, error string, fetch_ms long"
_Row = tuple[str, int, str | None, int, bool, bool, str | None, int]


def minute_name(at: int) -> str:
    return datetime.datetime.fromtimestamp(at - at % 60, datetime.UTC).strftime("%Y-%m-%dT%H:%M:00Z")


def slot_at(now: float) -> int:
    """How many read slots have come up until ``now``."""
    return len(SLOTS) * int(now // 60) + sum(s <= now % 60 for s in SLOTS)


def reads(start: int, end: int) -> list[tuple[int, bool]]:
    """The (minute in seconds, closed) to read for the slots from ``start`` to before ``end``."""
    slots = [(k // len(SLOTS) * 60, SLOTS[k % len(SLOTS)]) for k in range(start, end)]
    out = [(m - 60, True) for m, s in slots if s == CLOSED]
    opened = [m for m, s in slots if s != CLOSED]
    return out + [(opened[-1], False)] if opened else out


class Recorded:
    """Answers from files: ``<minute>.<page>.json``, or ``<minute>.<page>.<try>.json`` for those that change with each try.
    A file that ends in ``.err`` is a failure, and a page without any file too. ``open.<page>.json`` is the open minute."""

    def __init__(self, path: str):
        self.files, self.path = fs.FileSystem.from_uri(path)
        self.tries: dict[str, int] = {}

    def _first(self, names: list[str]) -> bytes:
        for n in names:
            for end in (".json", ".err"):
                where = f"{self.path}/{n}{end}"
                if self.files.get_file_info(where).type == fs.FileType.File:
                    with self.files.open_input_stream(where) as f:
                        body = f.read()
                    if end == ".err":
                        raise OSError(body.decode() or "no answer")
                    return body
        raise OSError(f"no page {names[-1]}")

    def page(self, minute: str | None, cursor: str | None) -> bytes:
        name = f"{minute.replace(':', '') if minute else 'open'}.{cursor or 0}"
        k = self.tries[name] = self.tries.get(name, -1) + 1
        return self._first([*(f"{name}.{n}" for n in range(k, -1, -1)), name])

    def whole(self, poll: int) -> bytes:
        with self.files.open_input_stream(f"{self.path}/{poll}.pb") as f:
            return f.read()


class Http:
    def __init__(self, url: str):
        self.url = url

    def _get(self, query: dict) -> bytes:
        with urllib.request.urlopen(f"{self.url}?{urllib.parse.urlencode(query)}" if query else self.url, timeout=30) as r:
            return r.read()

    def page(self, minute: str | None, cursor: str | None) -> bytes:
        return self._get({"limit": LIMIT} | ({"minuto_utc": minute} if minute else {}) | ({"cursor": cursor} if cursor else {}))

    def whole(self, poll: int) -> bytes:
        return self._get({})


def client(path: str) -> Recorded | Http:
    return Http(path) if path.startswith(("http://", "https://")) else Recorded(path)


def _pages(c: Recorded | Http, minute: str | None) -> Iterator[tuple[str, int, int]]:
    """``(body, rows, newest second)`` of a minute's pages, as far as the cursor goes and eight at most."""
    cursor = None
    for _ in range(MAX_PAGES):
        body = c.page(minute, cursor)
        page = json.loads(body)
        data = page.get("data") or []
        stamps = [s for r in data if (s := r.get("datetime_servidor"))]
        yield body.decode("utf-8", "replace"), len(data), max((int(s[17:19]) for s in stamps if s[17:19].isdigit()), default=0)
        cursor = page.get("next_cursor")
        if not cursor:
            return


@dataclass
class Minute(InputPartition):
    at: int
    closed: bool
    warming: bool


class _Minutes:
    """What the batch and the stream of minutes have in common: how one minute is fetched, on an executor."""

    def __init__(self, options: dict):
        self.path, self.typical = options["path"], float(options.get("typical", 4000))
        self.retries, self.wait = int(options.get("retries", RETRIES)), float(options.get("retry_s", RETRY_S))

    def read(self, part: Minute) -> Iterator[_Row]:
        c, name, began, pages, k = client(self.path), minute_name(part.at), time.time(), [], 0
        ms = lambda: int((time.time() - began) * 1000)
        try:
            for k in range(self.retries + 1):
                pages = list(_pages(c, name if part.closed else None))
                complete = not part.closed or (sum(n for _, n, _ in pages) >= SHARE * self.typical and max(s for _, _, s in pages) >= LAST_SECOND)
                if complete or k == self.retries:
                    break
                time.sleep(self.wait)
        except (OSError, ValueError) as e:  # the feed's failures; the batch goes on with what the others bring
            yield name, -1, None, 0, False, part.warming, f"{type(e).__name__}: {e}", ms()
            return
        for n, (body, rows, _) in enumerate(pages):
            yield name, n, body, rows, complete, part.warming, None, ms()


class MinuteBatch(_Minutes, DataSourceReader):
    """The closed minutes from ``from`` to before ``to`` (seconds), a task each; with ``warming`` their rows are flagged."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.first, self.last, self.warming = int(options["from"]), int(options["to"]), options.get("warming", "false") == "true"

    def partitions(self) -> list[Minute]:
        return [Minute(m, True, self.warming) for m in range(self.first - self.first % 60, self.last, 60)]


class MinuteStream(_Minutes, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.options = options

    def now(self) -> float:
        """The clock, or the seconds written in a file named by the option ``clock``."""
        if "clock" not in self.options:
            return time.time()
        files, path = fs.FileSystem.from_uri(self.options["clock"])
        with files.open_input_stream(path) as f:
            return float(f.read())

    def initialOffset(self) -> dict:
        return {"slot": int(self.options.get("start", slot_at(self.now())))}

    def latestOffset(self) -> dict:
        """Not before the first slot: a stream that is handed over to before its first slot waits for it."""
        return {"slot": max(slot_at(self.now()), int(self.options.get("start", 0)))}

    def partitions(self, start: dict, end: dict) -> list[Minute]:
        return [Minute(m, closed, False) for m, closed in reads(start["slot"], end["slot"])]


class PagedMinutes(DataSource):
    """``spark.dataSource.register(PagedMinutes)``, then ``read`` or ``readStream`` of ``minutes_paged`` with option ``path``: the
    feed's address or a folder of recorded answers."""

    @classmethod
    def name(cls) -> str:
        return "minutes_paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MinuteBatch:
        return MinuteBatch(self.options)

    def streamReader(self, schema) -> MinuteStream:
        return MinuteStream(self.options)


def warm_start(spark: SparkSession, options: dict, now: int, minutes: int) -> tuple[DataFrame, dict]:
    """The last closed minutes before ``now`` as a batch, flagged as warming, and the options of the stream that goes on from there.

    The stream's first slot is that which reads the minute after the batch's last: nothing is read twice, nothing left out.
    """
    last = now - now % 60
    batch = spark.read.format("minutes_paged").options(**options, **{"from": last - 60 * minutes, "to": last, "warming": "true"}).load()
    return batch, {**options, "start": len(SLOTS) * (last // 60 + 1)}


@dataclass
class Poll(InputPartition):
    number: int
    at: int


class PollStream(MinuteStream):
    """An offset counts polls; a stream that has fallen behind makes the newest one only, since each holds the whole fleet."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.every = int(options.get("every_s", POLL_S))

    def initialOffset(self) -> dict:
        return {"poll": int(self.now() // self.every)}

    def latestOffset(self) -> dict:
        return {"poll": int(self.now() // self.every)}

    def partitions(self, start: dict, end: dict) -> list[Poll]:
        return [Poll(end["poll"], end["poll"] * self.every)] if end["poll"] > start["poll"] else []

    def read(self, part: Poll) -> Iterator[tuple]:
        try:
            yield client(self.path).whole(part.number), part.at, None
        except OSError as e:
            yield None, part.at, f"{type(e).__name__}: {e}"


class PolledFeed(DataSource):
    """The binary feed as a stream of whole messages: ``content, received, error``."""

    @classmethod
    def name(cls) -> str:
        return "feed_polled"

    def schema(self) -> str:
        return "content binary, received long, error string"

    def streamReader(self, schema) -> PollStream:
        return PollStream(self.options)


def observed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of a feed without its failures; how many came, failed and stayed incomplete is observed under ``name``."""
    held = [F.count("*").alias("fetched"), F.count("error").alias("failed")]
    if "complete" in rows.columns:
        held += [F.count_if(~F.col("complete") & F.col("error").isNull()).alias("incomplete"), F.sum("rows").alias("rows")]
    return rows.observe(name, *held).where(F.col("error").isNull())


class FetchCounts(StreamingQueryListener):
    """Sums what ``observed`` has seen over all batches of all queries: a source's name to its counts."""

    def __init__(self):
        self.counts: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            mine = self.counts.setdefault(name, {})
            for k, v in row.asDict().items():
                mine[k] = mine.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
