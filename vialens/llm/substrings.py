"""Substring dedup: prefix-partitioned suffix trees over sampled suffixes, whose deep internal nodes give the maximal repeats.

Of the suffixes of all texts, only those are indexed that start at a *minimizer*: the place of the least hash of GRAM words
in some window of WINDOW words. Equal windows have it at the same offset, so each window is judged at one indexed suffix.
A suffix whose first GRAM words start no other indexed suffix ends there; the rest are dealt by this prefix into groups that
fit in memory. A group's suffixes are sorted, neighbours' common prefixes give the tree's internal nodes, and the same is done
for the words to the left, read backwards. A window repeats if at least two suffixes share a node on either side whose depths
sum to WINDOW. A prefix with more than ``hot`` suffixes is extended to whole windows, which native counting then compares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialens.llm.common import written

WINDOW, GRAM = 35, 8
_KEPT_WORDS = 400_000
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """Word to XXH64; emptied when it has grown past a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K1 + b
    x ^= x >> np.uint64(29)
    x *= _K2
    return x ^ (x >> np.uint64(32))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def minimizers(words: list[bytes], window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one minimizer: the gram's hash, its place, and the first and last window starts."""
    n = len(words) - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    step = 1
    while step < gram:
        h = _mix(h[:-step], h[step:])
        step *= 2
    near = np.lib.stride_tricks.sliding_window_view(h, window - gram + 1)
    place = np.arange(n) + near.argmin(1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    return h[place[first]].view(np.int64), place[first], first, last


def repeated_in_group(group: np.ndarray, left: list[list[bytes]], right: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes with their ``group`` (prefix), the words to the left (nearest first) and from their start on: the least and
    the largest offset of a repeated window that starts that many words to the left (-1: none)."""
    n, ids = len(group), {}
    code = lambda w: ids.setdefault(w, len(ids))
    nodes, lengths = [], []
    for side in (left, right):
        size = np.fromiter(map(len, side), np.int64, n)
        wide = int(size.max(initial=0))
        m = np.repeat(-1 - np.arange(n, dtype=np.int32)[:, None], max(wide, 1), 1)  # a row's padding equals no other row's
        for r, ws in enumerate(side):
            m[r, : len(ws)] = [code(w) for w in ws]
        order = np.lexsort([*m.T[::-1], group])
        same = (m[order][1:] == m[order][:-1]) & (group[order][1:] == group[order][:-1])[:, None]
        shared = np.cumprod(same, 1, dtype=np.int8).sum(1)  # words shared by neighbours: depths of the tree's internal nodes
        nodes.append((order, shared, group))
        lengths.append(size)

    def node(side: int, depth: int) -> np.ndarray:
        order, shared, g = nodes[side]
        split = shared < depth if depth else g[order][1:] != g[order][:-1]
        out = np.empty(n, np.int64)
        out[order] = np.concatenate([[0], np.cumsum(split)])
        return out

    least, most = np.full(n, -1), np.full(n, -1)
    for j in range(int(lengths[0].max(initial=0)) + 1):
        fit = np.flatnonzero((lengths[0] >= j) & (lengths[1] >= window - j))
        if len(fit) < 2:
            continue
        _, at, count = np.unique(node(0, j)[fit] * n + node(1, window - j)[fit], return_inverse=True, return_counts=True)
        hit = fit[count[at] > 1]
        least[hit] = np.where(least[hit] < 0, j, least[hit])
        most[hit] = j
    return least, most


def repeated_spans(docs: DataFrame, window: int = WINDOW, hot: int = 100_000, chunk: int = 20_000) -> DataFrame:
    """``row_key, first, after``: spans of words covered by windows that start anywhere else too. ``docs`` has ``row_key`` and ``text``."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, keys, counts = [], [], []
            for key, text in zip(b.column("row_key").to_pylist(), b.column("text").to_pylist(), strict=True):
                g, n = np.unique(minimizers(split_words(text), window)[0], return_counts=True)
                grams.append(g)
                counts.append(n)
                keys.append(np.full(len(g), key))
            flat = lambda xs: pa.array(np.concatenate([np.zeros(0, np.int64), *xs]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([flat(grams), flat(counts), flat(keys)], names=["gram", "n", "row_key"])

    indexed = written(docs.select("row_key", "text").mapInArrow(index, "gram bigint, n bigint, row_key bigint"), "index")  # read twice
    repeated = written(indexed.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram", (F.col("n") > hot).alias("hot")), "grams")
    mine = indexed.select("gram", "row_key").join(repeated, "gram").groupBy("row_key").agg(F.collect_set("gram").alias("grams"), F.collect_set(F.when(F.col("hot"), F.col("gram"))).alias("hot_grams"))
    found = docs.join(mine, "row_key")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["gram", "hot", "row_key", "place", "back", "words"]
        for b in batches:
            rows: list[tuple] = []
            for key, text, grams, hots in zip(*(b.column(c).to_pylist() for c in ("row_key", "text", "grams", "hot_grams")), strict=True):
                words, wanted, hots = split_words(text), np.asarray(grams, np.int64), set(hots)
                g, place, first, last = minimizers(words, window)
                for k in np.flatnonzero(np.isin(g, wanted)):
                    p, lo, hi = int(place[k]), int(first[k]), int(last[k])
                    rows.append((int(g[k]), int(g[k]) in hots, key, p, p - lo, b" ".join(words[lo : hi + window])))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    # all columns of docs are read, so that the shuffle of docs is the same as that of the join which takes the spans up
    leaves = found.select(*docs.columns, "grams", "hot_grams").mapInArrow(suffixes, "gram bigint, hot boolean, row_key bigint, place int, back int, words binary")
    dealt = leaves.repartition(F.col("gram"), F.when(F.col("hot"), F.xxhash64("row_key", "place"))).sortWithinPartitions("hot", "gram")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row_key", "first", "after", "deep"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]

        def built(rows: list[tuple]) -> pa.RecordBatch:
            out: list[tuple] = []
            if rows:
                words = [r[5].split(b" ") for r in rows]
                left = [w[: r[4]][::-1] for w, r in zip(words, rows, strict=True)]
                right = [w[r[4] :] for w, r in zip(words, rows, strict=True)]
                least, most = repeated_in_group(np.asarray([r[0] for r in rows], np.int64), left, right, window)
                out = [(rows[k][2], rows[k][3] - int(most[k]), rows[k][3] - int(least[k]) + window, None) for k in np.flatnonzero(most >= 0)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

        def extended(rows: list[tuple]) -> pa.RecordBatch:
            """Suffixes of hot prefixes as whole windows: a node of depth ``window`` each, by a 128-bit hash."""
            out = []
            for r in rows:
                words, at = r[5].split(b" "), r[3] - r[4]
                out += [(r[2], at + k, at + k + window, xxhash.xxh128_digest(b" ".join(words[k : k + window]))) for k in range(len(words) - window + 1)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1]:
                    if held and not held[-1][1]:
                        yield built(held)
                        held = []
                    held.append(row)
                    if len(held) >= 2000:
                        yield extended(held)
                        held = []
                    continue
                if len(held) >= chunk and held[-1][0] != row[0]:
                    yield built(held)
                    held = []
                held.append(row)
        yield (extended if held and held[-1][1] else built)(held)

    spans = dealt.mapInArrow(trees, "row_key bigint, first int, after int, deep binary")
    if repeated.where("hot").isEmpty():
        return spans.select("row_key", "first", "after")
    spans = written(spans, "spans")
    done = spans.where("deep is null").select("row_key", "first", "after")
    deep = spans.where("deep is not null")
    twice = written(deep.groupBy("deep").count().where("count > 1").select("deep"), "twice")  # as a table, so that the join's hot windows are split
    return done.union(deep.join(twice, "deep").select("row_key", "first", "after"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, hot: int = 100_000) -> DataFrame:
    """Each row of ``docs`` (``doc_id``, ``text``; other columns are ignored) without the words that repeated windows cover.

    Returns ``doc_id, kept`` (words joined by one space, UTF-8 binary), ``n_words, n_removed``. A null text has no words; a
    text shorter than the window keeps all; repeated rows repeat each other's windows; an empty table gives none. Windows are
    judged on the input, wherever they start, in the same document too.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    spans = repeated_spans(rows, window, hot).groupBy("row_key").agg(F.collect_list(F.struct("first", "after")).alias("spans"))
    joined = rows.join(spans, "row_key", "left").select("doc_id", "text", F.col("spans.first").alias("firsts"), F.col("spans.after").alias("afters"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, firsts, afters in zip(*(b.column(c).to_pylist() for c in ("text", "firsts", "afters")), strict=True):
                words = split_words(text)
                n = len(words)
                if firsts:
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, firsts, 1)
                    np.add.at(depth, afters, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(depth[:n]) == 0)]
                out.append((b" ".join(words), n, n - len(words)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())], names=["doc_id", "kept", "n_words", "n_removed"])

    return joined.mapInArrow(cut, "doc_id bigint, kept binary, n_words bigint, n_removed bigint")
