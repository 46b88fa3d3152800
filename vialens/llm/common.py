"""What the corpus operators share: the shared folder, written tables, prefix sums and word counts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word is a run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, else the context's own.

    A session in one process that names none gets a temporary folder; a cluster that names none is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='vialens-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/vialens-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def column(name: str) -> Column:
    """A column by its exact name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(names: list[str]) -> Column:
    """All columns of a row as a struct, so that what is added beside it cannot clash with their names."""
    return F.struct(*map(column, names))


def row_key(names: list[str]) -> Column:
    """128 bits that tell rows apart by these columns, whatever their types; a null is not as if it were missing."""
    return F.unhex(F.md5(F.to_json(whole_row(names), {"ignoreNullFields": "false"})))


def word_count(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows, counted first; else as it is, for a shuffled join.

    For written tables of a few narrow columns: the bound keeps a broadcast at a few MB.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def prefix_by_key(totals: DataFrame, key: str, value: str, out: str, chunk: int = 4096) -> DataFrame:
    """Exclusive prefix sums of ``value`` in the order of the integer ``key``, in two levels so that no task gets all keys."""
    block = (F.col(key) / chunk).cast("long")
    rows = totals.withColumn("__block", block)
    heads = rows.groupBy("__block").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__head"))
    within = Window.partitionBy("__block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(F.broadcast(heads), "__block").withColumn(out, (F.col("__own") + F.col("__head")).cast("long")).drop("__block", "__own", "__head")


def ordered_prefix(df: DataFrame, order: list[str], values: list[str], tag: str) -> DataFrame:
    """Adds ``<v>_before`` (long) for each ``v`` of ``values``: the sum of the long ``v`` over all earlier rows in ``order``.

    Rows are dealt by range and sorted, each task sums its own rows, the result is written, and the tasks' totals
    (a row a task) give each task's start. Rows that tie in ``order`` may take either place. An empty table stays empty.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), *(T.StructField(f"__{v}", T.LongType()) for v in values)])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, past = TaskContext.get().partitionId(), dict.fromkeys(values, 0)
        for b in batches:
            arrays = list(b.columns) + [pa.array(np.full(b.num_rows, part, np.int32))]
            for v in values:
                x = b.column(v).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(x)
                arrays.append(pa.array(total - x + past[v]))
                past[v] += int(total[-1]) if len(total) else 0
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(running, schema), tag)
    ends = rows.groupBy("__part").agg(*(F.max(F.col(f"__{v}") + F.col(v)).alias(f"__end_{v}") for v in values))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select("__part", *(F.coalesce(F.sum(f"__end_{v}").over(before), F.lit(0)).alias(f"__head_{v}") for v in values))
    out = rows.join(F.broadcast(heads), "__part")  # a row for each task of the write
    for v in values:
        out = out.withColumn(f"{v}_before", (F.col(f"__{v}") + F.col(f"__head_{v}")).cast("long"))
    return out.select(*df.columns, *(f"{v}_before" for v in values))
