"""The formats of tile archives: directories and Hilbert ids of a single-file archive, and the features of a vector tile."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np

from vialens.sources.feeds import protobuf_fields


def zxy(tile_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zooms, columns and rows of Hilbert tile ids: an id counts all tiles of smaller zooms first."""
    t = np.asarray(tile_id, np.int64)
    firsts = np.cumsum([0, *(1 << 2 * z for z in range(30))])
    z = np.searchsorted(firsts, t, "right") - 1
    t, x, y = t - firsts[z], np.zeros_like(t), np.zeros_like(t)
    for k in range(int(z.max(initial=0))):
        s, live = 1 << k, k < z
        rx = t >> 1 & 1
        ry = (t ^ rx) & 1
        flip, swap = live & (ry == 0) & (rx == 1), live & (ry == 0)
        x, y = np.where(flip, s - 1 - x, x), np.where(flip, s - 1 - y, y)
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        x, y, t = np.where(live, x + s * rx, x), np.where(live, y + s * ry, y), np.where(live, t >> 2, t)
    return z, x, y


def varints(data: bytes) -> list[int]:
    out, v, shift = [], 0, 0
    for b in data:
        v |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(v)
            v = shift = 0
    return out


def inflate(data: bytes, codec: int) -> bytes:
    """Codecs 0 and 1 are none, 2 is gzip; others are refused."""
    if codec in (0, 1):
        return data
    if codec != 2:
        raise ValueError(f"compression {codec} is not read")
    return gzip.decompress(data)


def directory(data: bytes) -> list[tuple[int, int, int, int]]:
    """(tile id, run length, offset, length) entries: ids by difference, an offset of 0 for one right after the last entry."""
    v = varints(data)
    n, out, tile_id, end = v[0], [], 0, 0
    for k in range(n):
        tile_id += v[1 + k]
        run, length, offset = v[1 + n + k], v[1 + 2 * n + k], v[1 + 3 * n + k]
        at = end if offset == 0 and k else offset - 1
        end = at + length
        out.append((tile_id, run, at, length))
    return out


def zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def geometry(commands: list[int]) -> list[list[tuple[int, int]]]:
    """The parts of a feature: each move starts one, and what follows a close; a closed part does not repeat its first point."""
    parts: list[list[tuple[int, int]]] = []
    x = y = k = 0
    closed = True
    while k < len(commands):
        kind, n = commands[k] & 7, commands[k] >> 3
        k += 1
        if kind == 7:
            closed = True
            continue
        if kind not in (1, 2):
            break
        for _ in range(n):
            if k + 1 >= len(commands):
                return parts
            x, y, k = x + zigzag(commands[k]), y + zigzag(commands[k + 1]), k + 2
            if kind == 1 or closed:
                parts.append([])
                closed = False
            parts[-1].append((x, y))
    return parts


def _value(message: bytes):
    for field, _, v in protobuf_fields(message):
        if field == 1:
            return v.decode("utf-8", "replace")
        if field in (2, 3):
            return struct.unpack("<f" if field == 2 else "<d", v)[0]
        if field in (4, 5):
            return v - (1 << 64) if field == 4 and v >> 63 else v
        return zigzag(v) if field == 6 else bool(v)
    return None


def features(tile: bytes) -> Iterator[dict]:
    """layer, geom_type (1 points, 2 lines, 3 polygons), extent, props and parts of each feature."""
    for field, _, layer in protobuf_fields(tile):
        if field != 3 or not isinstance(layer, bytes):
            continue
        name, keys, values, found, extent = "", [], [], [], 4096
        for k, _, v in protobuf_fields(layer):
            if k == 1:
                name = v.decode("utf-8", "replace")
            elif k == 2:
                found.append(v)
            elif k == 3:
                keys.append(v.decode("utf-8", "replace"))
            elif k == 4:
                values.append(_value(v))
            elif k == 5:
                extent = v
        for f in found:
            kind, tags, commands = 0, [], []
            for k, _, v in protobuf_fields(f):
                if k == 2:
                    tags = varints(v)
                elif k == 3:
                    kind = v
                elif k == 4:
                    commands = varints(v)
            props = {keys[a]: str(values[b]) for a, b in zip(tags[::2], tags[1::2], strict=False) if a < len(keys) and b < len(values)}
            yield {"layer": name, "geom_type": kind, "extent": extent, "props": props, "parts": geometry(commands)}
