"""Two-pass external shuffle: seeded scatter into memory-sized buckets, a Fisher-Yates shuffle of each, shards cut by place."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialens.llm.common import fresh_path, prefix_by_key


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation of 0..n-1 by Fisher-Yates swaps, the same for the same seed."""
    rng, order = np.random.Generator(np.random.PCG64(seed)), list(range(n))
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist(), strict=True):
        order[i], order[j] = order[j], order[i]
    return np.asarray(order, np.int64)


def external_shuffle(docs: DataFrame, path: str | None = None, n_shards: int = 16, seed: int = 20, bucket_bytes: int = 24 << 20) -> DataFrame:
    """Shuffles all rows of ``docs`` (``doc_id``, ``text``; other columns are ignored) and deals them into shards.

    Pass one scatters each record by a seeded hash of its id and text into buckets of about ``bucket_bytes``; pass two
    sorts a bucket by that hash, shuffles it by Fisher-Yates, and writes it with its places under ``path``. The places
    of all buckets in turn form one order, cut into ``n_shards`` runs whose row counts differ by at most one.
    Reruns agree. Null texts (0 bytes) and null ids are kept; repeated rows are interchangeable; an empty table gives none.
    Returns ``doc_id, text, size`` (bytes and one), ``bucket, place, shard, slot``, read back from the written files.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "shards")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    total = rows.agg(F.sum("size")).first()[0] or 0
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text"))
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(n_buckets)).cast("long"))

    schema = "bucket bigint, doc_id bigint, text string, size bigint, place bigint"
    names = ["bucket", "doc_id", "text", "size"]

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one bucket a task
        if held:
            bucket = pa.Table.from_batches(held).combine_chunks().sort_by([("h", "ascending"), ("doc_id", "ascending")])
            order = fisher_yates(bucket.num_rows, [seed, bucket.column("bucket")[0].as_py()])
            for k in range(0, len(order), 4096):
                part = bucket.select(names).take(pa.array(order[k : k + 4096])).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in part.columns), pa.array(np.arange(k, k + part.num_rows))], names=[*names, "place"])

    dealt = rows.repartitionById(n_buckets, F.col("bucket").cast("int"))
    dealt.select(*names, "h").mapInArrow(shuffle, schema).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    starts = prefix_by_key(out.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "n", "first")
    n = out.count()
    at = F.col("first") + F.col("place")
    out = out.join(F.broadcast(starts.select("bucket", "first")), "bucket")  # a row a bucket of 24 MB
    shard = F.floor(at * n_shards / F.lit(max(n, 1))) if n == 0 else F.expr(f"(first + place) * {n_shards} div {n}")
    out = out.withColumn("shard", shard.cast("int"))
    return out.select("doc_id", "text", "size", "bucket", "place", "shard", F.expr(f"first + place - (shard * {n}L + {n_shards - 1}) div {n_shards}").cast("long").alias("slot"))
