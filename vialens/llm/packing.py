"""Conflict-constrained best-fit packing of documents into bins of equal capacity."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialens.llm.common import word_count, written

CAPACITY, GROUP_ROWS = 2048, 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each item, taken in turn: the tightest bin that holds neither its source nor its cluster, else a new one.

    Bins stand in order of what is left in them. From the first that has room, the search goes on to its successors until
    neither bitmap of the bin, of sources and of clusters, has the item's bit.
    """
    bit: dict = {}
    open_bins: list[tuple[int, int]] = []  # (what is left, bin), ordered
    held_sources: list[int] = []
    held_clusters: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << bit.setdefault(("s", source), len(bit)), 1 << bit.setdefault(("c", cluster), len(bit))
        k = bisect_left(open_bins, (size, -1))
        while k < len(open_bins) and (held_sources[open_bins[k][1]] & s or held_clusters[open_bins[k][1]] & c):
            k += 1
        if k < len(open_bins):
            left, b = open_bins.pop(k)
        else:
            left, b = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[b] |= s
        held_clusters[b] |= c
        if left > size:
            insort(open_bins, (left - size, b))
        out.append(b)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, source: str = "source", clusters: DataFrame | None = None) -> DataFrame:
    """Packs every row of ``docs`` (``doc_id``, ``text``, ``source``; other columns are ignored) into bins of ``capacity`` words.

    No bin holds two documents of one source or of one duplicate cluster: that which ``clusters`` (``doc_id``, ``cluster``)
    gives for the id, or for that of a document of equal text, else the documents of equal text. A document longer than a bin is
    cut into full bins and a rest; the rest is packed like any other. Rows are dealt by a hash into groups of about
    ``group_rows``, whatever their source or cluster, and each group is packed largest first; so a hot source or a large
    cluster is spread evenly, and a task holds sizes and ids only.
    Returns a row for each piece: ``bin`` (long), ``doc_id, source, piece, start_word, n_words, bin_words``.
    Null texts and texts without words are pieces of 0 words; null sources are one source; repeated rows are packed each;
    an empty table gives none. Reruns agree.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("cluster"))
    if clusters is not None:
        own = clusters.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.min("cluster").alias("given"))
        rows = rows.join(own, F.col("doc_id") == F.col("i"), "left")
        # a row whose id has no cluster, or that has no id, is in the cluster of a row with its text
        of_text = rows.where("given is not null").groupBy(F.col("cluster").alias("text_key")).agg(F.min("given").alias("shared"))
        rows = rows.join(of_text, F.col("cluster") == F.col("text_key"), "left").withColumn("given", F.coalesce("given", "shared"))
        rows = rows.select("doc_id", "source", "size", F.when(F.col("given").isNull(), F.col("cluster")).otherwise(F.xxhash64("given")).alias("cluster"))
    rows = written(rows, "pieces")
    groups = max(1, math.ceil(rows.count() / group_rows))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "cluster", "source"), F.lit(groups)).cast("long"))

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "cluster", "source", "size"], kind="stable", na_position="last").reset_index(drop=True)
        full, rest = g["size"] // capacity, g["size"] % capacity
        whole = g.loc[g.index.repeat(full)]
        piece = whole.groupby(level=0).cumcount()
        whole = whole.assign(piece=piece, n_words=capacity, bin=range(len(whole)))
        rests = g.assign(piece=full, n_words=rest)[(rest > 0) | (g["size"] == 0)]
        rests = rests.sort_values("n_words", ascending=False, kind="stable")
        bins = best_fit(rests["n_words"].tolist(), rests["source"].tolist(), rests["cluster"].tolist(), capacity)
        out = pd.concat([whole, rests.assign(bin=[len(whole) + b for b in bins])])
        out["bin"] = out["bin"] + (g["grp"].iloc[0] << 32)
        out["start_word"] = out["piece"] * capacity
        out["bin_words"] = out.groupby("bin")["n_words"].transform("sum")
        return out[["bin", "doc_id", "source", "piece", "start_word", "n_words", "bin_words"]].astype({"piece": "int32"})

    schema = "bin bigint, doc_id bigint, source string, piece int, start_word bigint, n_words bigint, bin_words bigint"
    return rows.groupBy("grp").applyInPandas(packed, schema)
