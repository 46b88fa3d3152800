"""Substring dedup over bytes: repeats of a fixed length, found by column-wise construction of pieces' Burrows-Wheeler transforms.

A *window* is WINDOW consecutive bytes of one text. Each window is judged at its minimizer, the place of the least hash of GRAM
bytes in it: equal windows have theirs at the same offset. A *piece* is the text that the windows of one minimizer cover. Pieces
of one gram form a collection, aligned at the gram; equal pieces are inserted once, with their number. A collection is built
from the right, one symbol of every piece a round: the symbols in the order of the suffixes so far are the round's column of
the transform, sorting them stably gives the next order, and the lengths of common prefixes of neighbours follow from the
least ones between. A window repeats where a common prefix reaches WINDOW, or where its piece stands in more than one place.

The external files are Spark's: index, kinds, pieces and verdicts are written tables or shuffles, sorted by collection, which
tasks read once from front to back; a task holds one chunk of collections. A collection of more than ``crowd`` pieces is split:
its windows are parted into two ranges of offsets, and the bytes that all windows of a range share make a longer key. Split
pieces that have become equal are counted and inserted once again, down to single windows, so that no collection is unbounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialens.llm.common import discard, small, written

WINDOW, GRAM = 400, 64
_BLOCK = 1 << 22  # bytes hashed at once
_SEED = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place on; ``gram`` is a power of two."""
    h, power, step = _SEED[codes], _ODD, 1
    while step < gram:
        h = h[:-step] * power + h[step:]
        with np.errstate(over="ignore"):
            power = power * power
        step *= 2
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values: suffix minima of one block and prefix minima of the next."""
    n = len(v) - width + 1
    blocks = -(-len(v) // width)
    padded = np.full(blocks * width, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(codes: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """For texts laid end to end (``ends``: where each stops) their runs of windows with one minimizer:
    the gram's hash, its place, the first and the last window start, and the number of the text."""
    n = len(codes) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = gram_hashes(codes, gram)
    place = (sliding_least((h & _HIGH) | np.arange(len(h), dtype=np.uint64), window - gram + 1) & _LOW).astype(np.int64)
    text = np.searchsorted(ends, np.arange(n), "right")
    whole = np.arange(n) + window <= ends[text]
    new = np.ones(n + 1, bool)
    new[1:n] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    cuts = np.flatnonzero(new)
    first, last = cuts[:-1], cuts[1:] - 1
    first, last = first[whole[first]], last[whole[first]]
    return h[place[first]].view(np.int64), place[first], first, last, text[first]


def _blocks(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end in blocks: the bytes, where each text ends, its number, and where in its text it begins. A longer
    text comes in several that overlap in all but one byte of a window, so that each window start is in one of them."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(t for _, _, t in held), np.uint8), np.cumsum([len(t) for _, _, t in held]), np.asarray([k for k, _, _ in held]), np.asarray([o for _, o, _ in held])

    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - window + 1, 0), _BLOCK):
            part = text[at : at + _BLOCK + window - 1]
            if held and size + len(part) > _BLOCK:
                yield out()
                held, size = [], 0
            held.append((k, at, part))
            size += len(part)
    if held:
        yield out()


def build(group: np.ndarray, texts: list[bytes], back: np.ndarray, copies: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest start of a repeated window in each piece (-1: none). ``group`` is the piece's collection and
    does not fall, ``back`` the place of the collection's gram in the piece, ``copies`` in how many places the piece stands."""
    m = len(texts)
    size = np.fromiter(map(len, texts), np.int64, m)
    least, most = np.full(m, -1), np.full(m, -1)
    if not m:
        return least, most
    start = int(back.max()) - back
    stop = start + size
    columns = np.zeros((m, int(stop.max())), np.uint8)
    for k, t in enumerate(texts):
        columns[k, start[k] : stop[k]] = np.frombuffer(t, np.uint8)
    columns = np.ascontiguousarray(columns.T)
    order, common = np.arange(m), np.zeros(m, np.int64)
    border = np.ones(m, bool)
    border[1:] = group[1:] != group[:-1]
    number = np.cumsum(border)
    for c in range(len(columns) - 1, -1, -1):
        symbol = columns[c][order].astype(np.int16) + 1
        symbol[(start[order] > c) | (stop[order] <= c)] = 0  # nothing to insert
        new = border.copy()
        new[1:] |= symbol[1:] != symbol[:-1]
        heads = np.flatnonzero(new)  # the transform's column in runs of one symbol
        rank = number[heads] * 257 + symbol[heads]
        moved = np.argsort(rank, kind="stable")
        floor = np.minimum.reduceat(common, heads)
        here, before = moved[1:], moved[:-1]
        joined = np.flatnonzero((rank[here] == rank[before]) & (symbol[heads[here]] > 0))
        length = np.diff(np.append(heads, m))[moved]
        at = np.cumsum(length) - length
        source = np.repeat(heads[moved] - at, length) + np.arange(m)
        order, symbol, common = order[source], symbol[source], common[source] + 1
        old = common[at[1:]] - 1
        common[at] = 0
        if len(joined):
            pairs = np.stack([before[joined] + 1, here[joined]], 1).ravel()
            common[at[1:][joined]] = np.minimum(np.minimum.reduceat(floor, pairs)[::2], old[joined]) + 1
        common[symbol == 0] = 0
        deep = common >= window
        if deep.any():
            deep[:-1] |= deep[1:]  # borders have no common prefix, so both are of one collection
            found = order[deep]
            least[found] = c - start[found]
            most[found] = np.where(most[found] < 0, least[found], most[found])
    many = copies > 1
    least[many], most[many] = 0, (size - window)[many]
    return least, most


_PIECE = "key binary, h binary, n bigint, back int, low int, high int, text binary"
_VERDICT = "key binary, h binary, least int, most int"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32()}
    cols = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(cols)], names=[c for c, _ in cols])


def judged(pieces: DataFrame, window: int, chunk: int) -> DataFrame:
    """``key, h, least, most`` of pieces with repeated windows; a collection is the pieces of one ``key``, all in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            changes = [k > 0 and r[0] != held[k - 1][0] for k, r in enumerate(held)]
            least, most = build(np.cumsum(changes), [r[4] for r in held], np.asarray([r[3] for r in held], np.int64), np.asarray([r[2] for r in held], np.int64), window)
            return _table([(held[k][0], held[k][1], int(least[k]), int(most[k])) for k in np.flatnonzero(most >= 0)], _VERDICT)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "h", "n", "back", "text")), strict=True):
                if len(held) >= chunk and held[-1][0] != row[0]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    return pieces.select("key", "h", "n", "back", "text").repartition("key").sortWithinPartitions("key").mapInArrow(run, _VERDICT)


def _split(pieces: DataFrame, window: int) -> DataFrame:
    """Pieces of crowded collections by the two halves of their offsets, with ``whole``: the (key, h) of the piece they are of.

    ``low`` and ``high`` bound how far before the gram a collection's windows start. All windows of a half share the bytes from
    its nearest start on to the end of its farthest window: these, the half and the old key are hashed into the new key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, h, n, back, low, high, text in zip(*(b.column(c.split()[0]).to_pylist() for c in _PIECE.split(", ")), strict=True):
                mid = (low + high) // 2
                for a, z in ((low, mid), (mid + 1, high)):
                    near, far = max(a, back - (len(text) - window)), min(z, back)
                    if near > far:
                        continue
                    part = text[back - far : back - near + window]
                    shared = text[back - a if back >= a else 0 : back - z + window]
                    new = xxhash.xxh128_digest(b"%d %d " % (a, z) + key + shared)
                    out.append((new, xxhash.xxh128_digest(b"%d " % far + part), n, far, a, z, part, key, h, back - far))
            yield _table(out, _PIECE + ", whole_key binary, whole_h binary, shift int")

    return pieces.mapInArrow(run, _PIECE + ", whole_key binary, whole_h binary, shift int")


def repeated_in_pieces(pieces: DataFrame, window: int, crowd: int, chunk: int, used: list[DataFrame]) -> DataFrame:
    """``key, h, least, most`` of all ``pieces`` with repeated windows, crowded collections split as often as they must be.

    Tables written on the way are added to ``used``, to be deleted once the result is written.
    """
    crowds = written(pieces.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowds")
    used.append(crowds)
    if crowds.isEmpty():
        return judged(pieces, window, chunk)
    crowds = small(crowds)
    done = judged(pieces.join(crowds, "key", "left_anti"), window, chunk)
    parts = written(_split(pieces.join(crowds, "key").select(*(c.split()[0] for c in _PIECE.split(", "))), window), "parts")
    used.append(parts)
    single = F.col("low") == F.col("high")  # a window each, and the key says which: counting is all that is left
    twice = parts.where(single).groupBy("key").agg(F.sum("n").alias("total")).where("total > 1").select("key")
    found = parts.where(single).select("key", "h").distinct().join(twice, "key").select("key", "h", F.lit(0).alias("least"), F.lit(0).alias("most"))
    rest = written(parts.where(~single).groupBy("key", "h").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("back", "low", "high", "text"))), "rest")
    used.append(rest)
    if not rest.isEmpty():
        found = found.union(repeated_in_pieces(rest, window, crowd, chunk, used))
    shift = F.col("shift")
    wholes = parts.select("key", "h", "whole_key", "whole_h", "shift").join(found, ["key", "h"])
    wholes = wholes.groupBy("whole_key", "whole_h").agg(F.min(F.col("least") + shift).alias("least"), F.max(F.col("most") + shift).alias("most"))
    return done.union(wholes.select(F.col("whole_key").alias("key"), F.col("whole_h").alias("h"), "least", "most"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = 50_000, chunk: int = 20_000) -> DataFrame:
    """``row_key, first, after``: the bytes covered by a minimizer's repeated windows, from its first such window's start to the
    end of the last; these are all covered, since a minimizer's windows start within less than a window of each other.

    ``docs``: ``row_key`` (binary), ``body`` (binary, not null).
    """
    place_of = "key binary, h binary, row_key binary, first int, size int, back int"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in place_of.split(", ")]
        for b in batches:
            keys = b.column("row_key")
            for codes, ends, number, offset in _blocks(b.column("body").to_pylist(), window):
                g, place, first, last, item = anchors(codes, ends, window, gram)
                size, back, view = last - first + window, place - first, memoryview(codes)
                names_of = [xxhash.xxh128_digest(view[f : f + s], k) for f, s, k in zip(first.tolist(), size.tolist(), back.tolist(), strict=True)]
                grams = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(g), [None, pa.py_buffer(np.ascontiguousarray(g).tobytes())]).cast(pa.binary())
                begins = ends - np.diff(np.append(0, ends)) - offset
                ints = (first - begins[item], size, back)
                yield pa.RecordBatch.from_arrays([grams, pa.array(names_of, pa.binary()), keys.take(pa.array(number[item])), *(pa.array(x.astype(np.int32)) for x in ints)], names=names)

    places = written(docs.select("row_key", "body").mapInArrow(index, place_of), "places")
    often = written(places.groupBy("key").count().where("count > 1").select("key"), "often")
    kinds = places.join(often, "key").groupBy("key", "h").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "first", "size", "back")).alias("at"))
    wanted = kinds.groupBy("at.row_key").agg(F.collect_list(F.struct("key", "h", "n", "at.first", "at.size", "at.back")).alias("wanted"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k, body in enumerate(b.column("body")):
                text = body.as_py()
                rows += [(w["key"], w["h"], w["n"], w["back"], 0, window - gram, text[w["first"] : w["first"] + w["size"]]) for w in b.column("wanted")[k].as_py()]
                if len(rows) >= 10_000:
                    yield _table(rows, _PIECE)
                    rows = []
            yield _table(rows, _PIECE)

    # rows that repeat both doc_id and text give a piece more than once: it stands in several places, so nothing changes
    pieces = written(docs.select("row_key", "body").join(wanted, "row_key").select("body", "wanted").mapInArrow(extract, _PIECE), "pieces")
    used = [often, pieces]
    verdicts = written(repeated_in_pieces(pieces, window, crowd, chunk, used), "verdicts")
    discard(*used)
    spans = written(places.select("key", "h", "row_key", "first").join(verdicts, ["key", "h"]).select("row_key", (F.col("first") + F.col("least")).alias("first"), (F.col("first") + F.col("most") + window).alias("after")), "spans")
    discard(places, verdicts)
    return spans


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = 50_000, chunk: int = 20_000) -> DataFrame:
    """Each row of ``docs`` (``doc_id``, ``text``; other columns are ignored) without the bytes that repeated windows cover.

    Returns ``doc_id, kept`` (the remaining bytes), ``n_bytes, n_removed, n_spans`` (maximal removed runs). Windows are judged on
    the input and start anywhere, in the same text too; none crosses documents. A null text is an empty one; a text shorter than
    ``window`` stays whole; repeated rows repeat each other's windows; rows without doc_id count like others; an empty table
    gives none. ``kept`` need not be valid UTF-8 where a removed run begins or ends inside a character.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":")).cast("binary")
    rows = rows.withColumn("row_key", F.unhex(F.md5(F.concat(name, F.col("body")))))
    spans = repeated_spans(rows, window, gram, crowd, chunk).groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("first", "after"))).alias("spans"))
    joined = rows.join(spans, "row_key", "left").select("doc_id", "body", F.col("spans.first").alias("firsts"), F.col("spans.after").alias("afters"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, body in enumerate(b.column("body")):
                text, removed, runs, kept, end = body.as_py(), 0, 0, [], 0
                firsts = b.column("firsts")[k].as_py() or []
                for first, after in zip(firsts, b.column("afters")[k].as_py() or [], strict=True):
                    if first > end or not runs:
                        kept.append(text[end:first])
                        runs += 1
                        end = first
                    removed += max(after - end, 0)
                    end = max(after, end)
                kept.append(text[end:])
                out.append((b"".join(kept), len(text), removed, runs))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64())))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(cut, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")
