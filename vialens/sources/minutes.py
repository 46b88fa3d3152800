"""A stream of closed minutes: landed JSON pages, read once their minute is complete."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class MinuteFeed(DataSource):
    """``spark.dataSource.register(MinuteFeed)``, then ``readStream.format("minutes").option("path", folder)``.

    Pages lie as ``<minute>.<page>.json``; an empty file ``<minute>.done`` closes a minute. The offset moves over closed minutes
    only, in order, and at most ``max_minutes`` at a time; a minute that never closes is passed over after ``patience`` later ones.
    """

    @classmethod
    def name(cls) -> str:
        return "minutes"

    def schema(self) -> str:
        return "minute string, page int, value string"

    def simpleStreamReader(self, schema) -> MinuteReader:
        return MinuteReader(self.options)


class MinuteReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.most, self.patience = options["path"], int(options.get("max_minutes", 10)), int(options.get("patience", 3))
        self.start = options.get("start", "")

    def initialOffset(self) -> dict:
        return {"minute": self.start}

    def _closed(self, after: str) -> list[str]:
        pages = sorted({os.path.basename(f).split(".")[0] for f in glob.glob(f"{self.path}/*.json")})
        done = {os.path.basename(f).split(".")[0] for f in glob.glob(f"{self.path}/*.done")}
        out = []
        for k, m in enumerate(pages):
            if m > after:
                if m not in done and len(pages) - k - 1 < self.patience:
                    break
                out.append(m)
        return out[: self.most]

    def _rows(self, minutes: list[str]) -> Iterator[tuple]:
        for m in minutes:
            for f in sorted(glob.glob(f"{self.path}/{m}.*.json")):
                with open(f, encoding="utf-8") as page:
                    yield m, int(os.path.basename(f).split(".")[1]), page.read()

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        minutes = self._closed(start["minute"])
        return self._rows(minutes), {"minute": minutes[-1] if minutes else start["minute"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        files = sorted({os.path.basename(f).split(".")[0] for f in glob.glob(f"{self.path}/*.json")})
        return self._rows([m for m in files if start["minute"] < m <= end["minute"]])


def land(folder: str, minute: str, page: int, body: dict, last: bool) -> None:
    """Writes a page as the stream reads it, and closes the minute after the last one."""
    with open(f"{folder}/{minute}.{page}.json.part", "w", encoding="utf-8") as f:
        json.dump(body, f)
    os.replace(f"{folder}/{minute}.{page}.json.part", f"{folder}/{minute}.{page}.json")
    if last:
        open(f"{folder}/{minute}.done", "w").close()
