"""Filter interaction audit: how five filters on texts overlap, in every order, for every part of the corpus.

Duplicates are found by sorting. Rows are dealt by ranges of (fingerprint, doc_id), so that a text with very many copies is
spread over many tasks, and sorted in each task by fingerprint, full text and doc_id; a row whose predecessor has the same text
and a smaller doc_id fails. A run of one text can go on in the next ranges: each task writes the text and the least doc_id of
the runs of its first and its last fingerprint, and the least rows of a run are judged again by the runs in earlier ranges.
Every document ends as a mask of the filters that it fails; masks are counted by part, and all orders are worked out on counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vialens.llm.common import written

FILTERS = "ABCDE"
SHORT_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, b"#$%&*|"
_E = 1 << FILTERS.index("E")
_ROW = "doc_id bigint, part string, mask int, range int, run bigint, least boolean, fp bigint, edge string"


def text_mask(text: bytes) -> int:
    """The filters A to D that a UTF-8 text fails, a bit each."""
    words = text.split()
    codes = np.frombuffer(text, np.uint8)
    capitals = int(np.count_nonzero((codes >= 65) & (codes <= 90)))
    points = int(np.count_nonzero((codes & 0xC0) != 0x80))
    few = len(words) < SHORT_WORDS
    repeats = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    symbols = any(s in text for s in SYMBOLS)
    return few | repeats << 1 | (100 * capitals > CAPITAL_PERCENT * points) << 2 | symbols << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: each row's mask, whether it is the least of its run, and the texts of edge runs."""
    part = TaskContext.get().partitionId()
    names = [c.split()[0] for c in _ROW.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
    run, first_fp, fp, text, mask, lowest = -1, None, None, None, 0, None
    early: list[tuple] = []  # finished runs of the current fingerprint: more than one only where fingerprints collide

    def edges(runs: list[tuple]) -> pa.RecordBatch:
        rows = [(low, None, None, part, k, None, f, t) for k, f, t, low in runs if low is not None]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(kinds))], names=names)

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        texts, fps, ids = b.column("text"), b.column("fp").to_numpy(zero_copy_only=False), b.column("doc_id").to_pylist()
        fresh = np.ones(n, bool)
        fresh[1:] = ~pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        fresh[0] = run < 0 or texts[0].as_py() != text
        masks, runs, least = np.empty(n, np.int32), np.empty(n, np.int64), np.empty(n, bool)
        starts = np.flatnonzero(fresh)
        for k, (a, z) in enumerate(zip([0, *starts], [*starts, n], strict=True)):
            if k:
                if run >= 0:
                    early.append((run, fp, text, lowest))
                if run >= 0 and fps[a] != fp:
                    if first_fp == fp:
                        yield edges(early)
                    early = []
                run, fp, text, lowest = run + 1, int(fps[a]), texts[int(a)].as_py(), None
                first_fp = fp if first_fp is None else first_fp
                mask = text_mask(text.encode("utf-8", "surrogatepass"))
            for i in range(a, z):
                here = ids[i]
                if lowest is None:
                    lowest = here
                masks[i], runs[i], least[i] = mask, run, here is not None and here == lowest
                if here is not None and here > lowest:
                    masks[i] |= _E
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(masks), pa.array(np.full(n, part, np.int32)), pa.array(runs), pa.array(least), b.column("fp"), pa.nulls(n, pa.string())], names=names)
    if run >= 0:
        yield edges([*early, (run, fp, text, lowest)])


def failure_masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` of every row of ``docs`` (``doc_id, text, lang``; other columns are ignored).

    A null text is an empty one, a null lang the part ''. A row without doc_id is neither a copy nor an original. Rows that
    repeat a doc_id and a text are not copies of each other. An empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("fp", F.xxhash64("text"))
    order = [F.col("fp"), F.col("text"), F.col("doc_id").asc_nulls_last()]
    judged = written(rows.repartitionByRange("fp", "doc_id").sortWithinPartitions(*order).mapInArrow(_judged, _ROW), "judged")
    edges = judged.where("edge is not null")  # the runs of two fingerprints a task
    before = Window.partitionBy("fp", "edge").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    late = edges.select("range", "run", (F.min("doc_id").over(before) < F.col("doc_id")).alias("late")).where("late")
    found = judged.where("mask is not null").join(late, ["range", "run"], "left")
    return found.select("doc_id", "part", F.when(F.col("least") & F.col("late"), F.col("mask").bitwiseOR(F.lit(_E))).otherwise(F.col("mask")).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: how many documents of a part fail exactly these filters, and how many are labelled so.

    Counts of several tables add up. A doc_id that ``labels`` has more than once is good or toxic if any of its rows says so.
    """
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    both = masks.join(said, "doc_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return both.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """All orders of the filters, step by step, from the counts of ``counters``."""
    orders = ",".join("".join(p) for p in itertools.permutations(FILTERS))
    n = len(FILTERS)
    steps = counts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    steps = steps.withColumn("bit", F.expr(f"shiftleft(1, locate(substring(filter_order, step, 1), '{FILTERS}') - 1)"))
    steps = steps.withColumn("earlier", F.expr(f"aggregate(sequence(0, step - 1), 0, (m, k) -> if(k = 0, m, m + shiftleft(1, locate(substring(filter_order, k, 1), '{FILTERS}') - 1)))"))
    fails, gone = F.expr("mask & bit != 0"), F.expr("mask & earlier != 0")
    add = lambda kept, c="n": F.sum(F.when(kept, F.col(c)).otherwise(0)).cast("long")
    orders_of_all = len(orders.split(","))
    share = F.when(fails, F.expr(f"n * ({orders_of_all} div greatest(bit_count(mask), 1))")).otherwise(0)  # first of its k failures in 1 / k of the orders
    return steps.groupBy("part", "filter_order", "step").agg(
        add(~fails & ~gone).alias("kept"),
        add(fails & ~gone).alias("removed"),
        add(fails & gone).alias("redundant"),
        add(F.expr("mask = bit")).alias("unique_fails"),
        add(fails & ~gone, "good").alias("good_lost"),
        add(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(share).cast("long").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and the step's counts, zeros included, for every lang of ``docs``."""
    masks = failure_masks(docs)
    return audit(counters(masks, labels))
