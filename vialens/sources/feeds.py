"""Live feeds: the aggregator's JSON pages and the binary vehicle positions of a real-time feed."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialens.functions import codes, times

ROW = "id_veiculo string, fornecedor string, modo string, servico string, sentido string, latitude double, longitude double, direcao double, velocidade double, shape_id string, trip_id string, datetime string, datetime_servidor string"
PAGE = f"minuto_utc string, data array<struct<{', '.join(c.replace(' ', ':') for c in ROW.split(', '))}>>, next_cursor string, providers_status map<string, string>"


def fixes_of_pages(pages: DataFrame) -> DataFrame:
    """Fixes of JSON pages (a column ``value``): unknown fields are ignored, malformed pages and rows without an id, a place or
    a time are dropped, blank codes become null, and a heading counts above 0 and up to 360 degrees."""
    rows = pages.select(F.from_json("value", PAGE, {"mode": "PERMISSIVE"}).alias("p")).select(F.explode("p.data").alias("r")).select("r.*")
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    out = rows.select(
        F.trim("id_veiculo").alias("vehicle"), codes.vendor(F.col("fornecedor")).alias("vendor"), times.parse_iso(F.col("datetime")).alias("t"), times.parse_iso(F.col("datetime_servidor")).alias("seen_at"),
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.when((F.col("direcao") > 0) & (F.col("direcao") <= 360), F.col("direcao")).alias("heading"), blank("servico").alias("service"),
        codes.direction(F.col("sentido")).alias("dir"), blank("shape_id").alias("shape_id"), blank("trip_id").alias("trip_id"), (F.coalesce(F.lower("modo") == "brt", F.lit(False)) | F.coalesce(codes.vendor(F.col("fornecedor")) == "sonda", F.lit(False))).alias("brt"), F.col("velocidade").alias("speed"),
    )
    return out.where("vehicle <> '' and lat is not null and lon is not null and t is not null")


def complete_minutes(batches: DataFrame, typical: float = 4000.0) -> DataFrame:
    """Batches (minute, rows, newest second) with ``complete``: enough rows, and a report of the minute's last quarter."""
    return batches.withColumn("complete", (F.col("rows") >= 0.6 * typical) & (F.col("newest_second") >= 45))


def provider_status(pages: DataFrame) -> DataFrame:
    """The status of each provider over pages in order (``page``, ``value``); the last page wins, other values become text."""
    p = pages.select("page", F.explode(F.from_json("value", "providers_status map<string, string>")["providers_status"]).alias("provider", "status"))
    return p.groupBy("provider").agg(F.max_by("status", "page").alias("status"))


def protobuf_fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of a protobuf message, as far as it can be read."""
    at = 0

    def varint() -> int:
        nonlocal at
        v = shift = 0
        while at < len(data) and shift < 64:
            b = data[at]
            at += 1
            v |= (b & 127) << shift
            if b < 128:
                return v
            shift += 7
        raise EOFError

    try:
        while at < len(data):
            tag = varint()
            kind = tag & 7
            if kind == 0:
                value: int | bytes = varint()
            elif kind in (1, 2, 5):
                size = 8 if kind == 1 else 4 if kind == 5 else varint()
                value, at = data[at : at + size], at + size
                if len(value) < size:
                    if kind == 2:
                        yield tag >> 3, kind, value  # what a cut-off message still holds
                    return
            else:
                return
            yield tag >> 3, kind, value
    except EOFError:
        return


# Field numbers of the real-time feed's messages.
ENTITY, VEHICLE = 2, 4
TRIP, POSITION, TIMESTAMP, DESCRIPTOR = 1, 2, 5, 8
POSITION_FIELDS = {1: "lat", 2: "lon", 3: "heading", 5: "speed"}
FIX = "vehicle string, vendor string, t long, lat double, lon double, heading double, service string, dir string, trip_id string, brt boolean"


def _position(message: bytes, received: int) -> dict | None:
    out: dict = {"vendor": "sonda", "t": received, "brt": True}
    label = None
    for field, _, value in protobuf_fields(message):
        if field == TIMESTAMP and isinstance(value, int) and value:
            out["t"] = value
        elif not isinstance(value, bytes):
            continue
        elif field == TRIP:
            for k, _, v in protobuf_fields(value):
                if k in (1, 5) and isinstance(v, bytes) and v.strip():
                    out["trip_id" if k == 1 else "service"] = v.decode("utf-8", "replace")
                elif k == 6 and v in (0, 1):
                    out["dir"] = ("ida", "volta")[v]
        elif field == POSITION:
            out |= {POSITION_FIELDS[k]: struct.unpack("<f", v)[0] for k, kind, v in protobuf_fields(value) if k in POSITION_FIELDS and kind == 5}
        elif field == DESCRIPTOR:
            ids = {k: v.decode("utf-8", "replace").strip() for k, _, v in protobuf_fields(value) if isinstance(v, bytes)}
            out["vehicle"], label = ids.get(1) or None, ids.get(2)
    out["vehicle"] = out.get("vehicle") or label
    if not out["vehicle"] or "lat" not in out or "lon" not in out:
        return None
    h = out.get("heading")
    out["heading"] = h if h is not None and 0 < h < float("inf") else None
    return out


def decode_positions(data: bytes, received: int) -> list[dict]:
    """The fixes of one feed message; what a cut-off message still holds is kept."""
    found = (_position(v, received) for k, _, e in protobuf_fields(data) if k == ENTITY and isinstance(e, bytes) for f, _, v in protobuf_fields(e) if f == VEHICLE and isinstance(v, bytes))
    return [f for f in found if f]


def fixes_of_messages(files: DataFrame) -> DataFrame:
    """Fixes of binary feed messages (``content`` binary, ``received`` seconds), such as ``binaryFile`` rows give."""
    names = [c.split()[0] for c in FIX.split(", ")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [f for c, r in zip(b["content"], b["received"], strict=True) for f in decode_positions(bytes(c), int(r))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("content", "received").mapInPandas(decode, FIX)
