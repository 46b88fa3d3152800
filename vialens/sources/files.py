"""Files by exact name on any file system that pyarrow reaches: ranges read, whole files put, documents that have changed."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialens.operators.stored import stored

if TYPE_CHECKING:
    from vialens.streaming.keyed import KeyedTable


def read_range(path: str, at: int, length: int) -> bytes:
    """``length`` bytes of a file from ``at`` on, or an error: nothing else of the file is read."""
    files, where = fs.FileSystem.from_uri(path)
    with files.open_input_file(where) as f:
        data = f.read_at(length, at)
    if len(data) != length:
        raise ValueError(f"{path} ends before {at + length}")
    return data


def write_whole(files: fs.FileSystem, path: str, body: bytes) -> None:
    """Writes a file so that a reader sees the old one or the new one whole."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        out.write(body)
    files.move(part, path)


def write_documents(docs: DataFrame, root: str, published: KeyedTable, batch: int, level: int = 6) -> dict[str, int]:
    """Writes the documents (``path``, ``body``) of which the body has changed, and deletes those no longer made.

    ``published`` holds the digest of each path as last written. Tasks write the files, each with its compressed twin, and each
    whole; a cycle that dies between files and digests writes the same files again.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(root)
        for b in batches:
            sizes = []
            for path, body in zip(b["path"], b["body"], strict=True):
                where = f"{base}/{path}"
                if body is None:
                    for name in (where, f"{where}.gz"):
                        if files.get_file_info(name).type != fs.FileType.NotFound:
                            files.delete_file(name)
                    sizes.append(0)
                    continue
                raw = body.encode()
                files.create_dir(where.rpartition("/")[0], recursive=True)
                write_whole(files, where, raw)
                write_whole(files, f"{where}.gz", gzip.compress(raw, level, mtime=0))
                sizes.append(len(raw))
            yield pd.DataFrame({"path": b["path"], "digest": b["digest"], "size": sizes})

    old = published.read().select("path", F.col("digest").alias("was"))
    new = docs.select("path", "body", F.md5("body").alias("digest"))
    changed = new.join(old, "path", "full").where(~F.col("was").eqNullSafe(F.col("digest")))
    made = stored(changed.select("path", "body", "digest").mapInPandas(put, "path string, digest string, size long"), "published")
    total = made.agg(F.count_if(F.col("digest").isNotNull()).alias("files"), F.count_if(F.col("digest").isNull()).alias("deleted"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    published.merge(made, batch, gone=F.col("digest").isNull())
    return total.asDict()
