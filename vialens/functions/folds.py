"""Ordered recurrences as folds over a sorted array, and polylines. A key's array must be bounded, such as an hour of a vehicle."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from vialens.constants import HALF_LIFE_S, MAX_SPEED_MS, MIN_GAP_S, PARKED_M


def ewma_speed(fixes: Column) -> Column:
    """The smoothed speed after an array of structs t, x, y in order: a sample counts once 10 s have passed since the last."""

    def step(a: Column, f: Column) -> Column:
        dt = (f["t"] - a["t"]).cast("double")
        now = F.least(F.sqrt(F.pow(f["x"] - a["x"], 2) + F.pow(f["y"] - a["y"], 2)) / dt, F.lit(MAX_SPEED_MS))
        v = a["v"] + (1.0 - F.pow(F.lit(0.5), dt / HALF_LIFE_S)) * (now - a["v"])
        return F.when(a["t"].isNull(), F.struct(f["t"].alias("t"), f["x"].alias("x"), f["y"].alias("y"), a["v"].alias("v"))).when(dt >= MIN_GAP_S, F.struct(f["t"].alias("t"), f["x"].alias("x"), f["y"].alias("y"), v.alias("v"))).otherwise(a)

    zero = F.expr("named_struct('t', cast(null as bigint), 'x', cast(null as double), 'y', cast(null as double), 'v', 0d)")
    return F.aggregate(fixes, zero, step)["v"]


def last_moved(fixes: Column) -> Column:
    """The time at which a vehicle last left the 100 m around where it had stood."""

    def step(a: Column, f: Column) -> Column:
        far = F.sqrt(F.pow(f["x"] - a["x"], 2) + F.pow(f["y"] - a["y"], 2)) > PARKED_M
        return F.when(a["t"].isNull() | far, F.struct(f["t"].alias("t"), f["x"].alias("x"), f["y"].alias("y"))).otherwise(a)

    return F.aggregate(fixes, F.expr("named_struct('t', cast(null as bigint), 'x', cast(null as double), 'y', cast(null as double))"), step)["t"]


def typical_rows(batches: Column, start: float = 4000.0) -> Column:
    """The smoothed number of rows of a complete batch: 0.8 of the value before and 0.2 of the new one."""
    return F.aggregate(batches, F.lit(start), lambda a, b: F.when(b["complete"], 0.8 * a + 0.2 * b["rows"]).otherwise(a))


def keep_apart(places: Column, metres: float) -> Column:
    """Of an array of structs with x and y, in order, those not within ``metres`` of one kept before."""
    kind = "array(cast(null as struct<x:double,y:double,id:bigint>))"
    return F.aggregate(
        places,
        F.expr(f"filter({kind}, z -> z is not null)"),
        lambda kept, p: F.when(F.exists(kept, lambda k: F.sqrt(F.pow(k["x"] - p["x"], 2) + F.pow(k["y"] - p["y"], 2)) < metres), kept).otherwise(F.concat(kept, F.array(F.struct(p["x"].alias("x"), p["y"].alias("y"), p["id"].alias("id"))))),
    )


def _encoded(values: np.ndarray) -> str:
    """Signed steps of one polyline, five bits a character, least first."""
    out = []
    for v in values.tolist():
        v = ~(v << 1) if v < 0 else v << 1
        while v >= 32:
            out.append(chr((v & 31 | 32) + 63))
            v >>= 5
        out.append(chr(v + 63))
    return "".join(out)


@pandas_udf(StringType())
def encode_polyline(points: pd.Series) -> pd.Series:
    """Arrays of flat (lat, lon, lat, lon, ...) degrees as text, five decimals."""

    def one(p: np.ndarray) -> str:
        q = np.rint(np.asarray(p, float).reshape(-1, 2) * 1e5).astype(np.int64)
        return _encoded(np.diff(q, axis=0, prepend=np.zeros((1, 2), np.int64)).ravel())

    return points.map(one)


@pandas_udf(ArrayType(DoubleType()))
def decode_polyline(text: pd.Series) -> pd.Series:
    def one(s: str) -> np.ndarray:
        steps, v, shift = [], 0, 0
        for c in s:
            b = ord(c) - 63
            v |= (b & 31) << shift
            shift += 5
            if b < 32:
                steps.append(~(v >> 1) if v & 1 else v >> 1)
                v, shift = 0, 0
        return (np.cumsum(np.asarray(steps).reshape(-1, 2), axis=0) / 1e5).ravel()

    return text.map(one)


def _flat(lines: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points (x, y) of all lines of a batch, where each line begins and, last, the last one ends, and which lines are null."""
    lines = lines.cast(pa.list_(pa.float64()))
    ends = np.concatenate([[0], np.cumsum(lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]) // 2
    return lines.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2), ends, lines.is_null().to_numpy(zero_copy_only=False)


def _lines(points: np.ndarray, keep: np.ndarray, ends: np.ndarray, null: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The kept points of each line as flat lists."""
    before = np.concatenate([[0], np.cumsum(keep)])[ends] * 2
    return pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(points[keep].ravel(), kind), mask=pa.array(null))


def _needed(q: np.ndarray, ends: np.ndarray, tol: np.ndarray) -> np.ndarray:
    """Whether each point is kept by its line's tolerance. All lines are split at once, a level a round: at each stretch's farthest
    point, the first of equals."""
    size = np.diff(ends)
    keep = np.zeros(len(q), bool)
    keep[ends[:-1][size > 0]] = keep[ends[1:][size > 0] - 1] = True
    a, b = ends[:-1], ends[1:] - 1
    while (wide := b - a >= 2).any():
        a, b, tol = a[wide], b[wide], tol[wide]
        inner = b - a - 1
        first = np.cumsum(inner) - inner
        of = np.repeat(np.arange(len(a)), inner)
        at = np.arange(len(of)) - first[of] + a[of] + 1
        d = q[b] - q[a]
        rel = q[at] - q[a][of]
        far = np.abs(rel[:, 0] * d[of, 1] - rel[:, 1] * d[of, 0]) / np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-9)[of]
        most = np.maximum.reduceat(far, first)
        split = most > tol
        hits = np.flatnonzero((far == most[of]) & split[of])
        k = at[hits[np.diff(of[hits], prepend=-1) > 0]]
        keep[k] = True
        a, b, tol = np.concatenate([a[split], k]), np.concatenate([k, b[split]]), np.concatenate([tol[split], tol[split]])
    return keep


def _whole(q: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points on whole numbers, halves away from zero, and whether each differs from the one before in its line."""
    q = (np.sign(q) * np.floor(np.abs(q) + 0.5)).astype(np.int32)
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]).any(1)
    fresh[ends[:-1][np.diff(ends) > 0]] = True
    return q, fresh


@arrow_udf(ArrayType(DoubleType()))
def simplified(points: pa.Array, tolerance: pa.Array) -> pa.Array:
    """Flat (x, y, ...) lines without the points that lie within a tolerance of the line through the ends around them; the ends stay."""
    q, ends, null = _flat(points)
    return _lines(q, _needed(q, ends, tolerance.to_numpy(zero_copy_only=False)), ends, null, pa.float64())


@arrow_udf(ArrayType(IntegerType()))
def quantised(points: pa.Array) -> pa.Array:
    """Flat (x, y, ...) lines on whole numbers, halves away from zero, without points that repeat the one before."""
    q, ends, null = _flat(points)
    return _lines(*_whole(q, ends), ends, null, pa.int32())


@arrow_udf(StructType([StructField("line", ArrayType(DoubleType())), StructField("flat", ArrayType(IntegerType()))]))
def on_grid(points: pa.Array, scale: pa.Array, extent: pa.Array, tolerance: pa.Array) -> pa.Array:
    """Lines of whole x and y times ``scale`` over ``extent``: flat and ``simplified`` as ``line``, and that ``quantised`` as ``flat``, in one pass."""
    size = points.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends, null = np.concatenate([[0], np.cumsum(size)]), points.is_null().to_numpy(zero_copy_only=False)
    at = points.flatten()
    q = np.column_stack([at.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")])
    q = q * np.repeat(scale.to_numpy(zero_copy_only=False), size)[:, None] / np.repeat(extent.to_numpy(zero_copy_only=False).astype(float), size)[:, None]
    keep = _needed(q, ends, tolerance.to_numpy(zero_copy_only=False))
    left, fewer = q[keep], np.concatenate([[0], np.cumsum(keep)])[ends]
    return pa.StructArray.from_arrays([_lines(q, keep, ends, null, pa.float64()), _lines(*_whole(left, fewer), fewer, null, pa.int32())], names=["line", "flat"])
