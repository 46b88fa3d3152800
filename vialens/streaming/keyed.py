"""A keyed table in versions: each merge writes a new one beside the old, then a pointer moves to it."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vialens.sources.files import write_whole


class KeyedTable:
    """The newest row of each key, kept in ``root`` as Parquet: ``root/CURRENT`` names the version that counts.

    A reader that has begun on a version is not disturbed by the next merge: the version before stays until the one after. A
    merge that dies leaves a folder that no pointer names. Each merge has a number; one not above the last is passed over, so
    that a batch that a stream hands over again changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str):
        self.spark, self.root, self.keys, self.schema = spark, root.rstrip("/"), keys, schema
        self.files, self.path = fs.FileSystem.from_uri(self.root)
        self.files.create_dir(self.path, recursive=True)

    def pointer(self) -> dict:
        where = f"{self.path}/CURRENT"
        if self.files.get_file_info(where).type == fs.FileType.NotFound:
            return {"folder": None, "before": None, "batch": -1}
        with self.files.open_input_stream(where) as f:
            return json.loads(f.read())

    def read(self) -> DataFrame:
        folder = self.pointer()["folder"]
        if folder is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}")

    def merge(self, changes: DataFrame, batch: int, newest: list[str] | None = None, gone: Column | None = None) -> bool:
        """Takes ``changes`` in: per key the last row by ``newest``, or none if ``gone`` holds for it. False: taken in before."""
        now = self.pointer()
        if batch <= now["batch"]:
            return False
        old = self.read()
        one = changes.select(*old.columns, (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"))
        if newest:
            rest = [c for c in one.columns if c not in self.keys]
            one = one.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("row")).select(*self.keys, "row.*")
        change, kept = one.alias("c"), old.alias("o")
        same = reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in self.keys))
        both = kept.join(change, same, "full")  # one pass over both sides; changes are computed once
        here = F.col("c.gone").isNotNull()
        rows = both.where(~F.coalesce("c.gone", F.lit(False))).select(*(F.when(here, F.col(f"c.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns))
        folder = f"v{batch:010d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.root}/{folder}")
        write_whole(self.files, f"{self.path}/CURRENT", json.dumps({"folder": folder, "before": now["folder"], "batch": batch}).encode())
        for info in self.files.get_file_info(fs.FileSelector(self.path)):
            if info.type == fs.FileType.Directory and info.base_name not in (folder, now["folder"]):
                self.files.delete_dir(info.path)
        return True
