"""Tile archives as rows: the directory's entries, leaf directories followed level by level, then tiles read by their byte ranges.

No task holds an archive: the header is 127 bytes, a directory is one row of work, and tiles are dealt by where they lie, so that
a task reads a stretch of the file from front to back.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import IntegerType, StructField, StructType

from vialens import constants as C
from vialens.functions import geo
from vialens.operators.stored import stored
from vialens.sources.files import read_range
from vialens.sources.tiles import directory, features, inflate, zxy

#: Directories lie at most so deep below the root.
MOST_LEVELS = 8
#: Neighbouring tiles are read at once up to so many bytes, and over gaps of so many.
READ, GAP = 8 << 20, 64 << 10


@udtf(returnType="tile_id: bigint, run: bigint, place: bigint, size: bigint")
class Directory:
    """The entries of the directory at a byte range of an archive."""

    def eval(self, path: str, at: int, size: int, codec: int):
        yield from directory(inflate(read_range(path, at, size), codec))


@pandas_udf(StructType([StructField(c, IntegerType()) for c in "zxy"]))
def tile_of_id(tile_id: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(dict(zip("zxy", zxy(tile_id.to_numpy()), strict=True)))


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path in b["path"]:
            head = read_range(path, 0, 127)
            if head[:7] != b"PMTiles" or head[7] != 3:
                raise ValueError(f"{path} is not a version 3 tile archive")
            root, size, _, _, leaves, _, tiles, _ = struct.unpack_from("<8Q", head, 8)
            rows.append((path, root, size, leaves, tiles, head[97], head[98]))
        yield pd.DataFrame(rows, columns=["path", "at", "size", "leaves", "tiles", "inner", "outer"])


def entries(archives: DataFrame) -> DataFrame:
    """``path, tile_id, run, at, size, outer``: each run of tiles with its byte range, of archives named by ``path``.

    Each level of directories is written once; its directories are dealt to tasks and read there, each by its own range.
    """
    spark = archives.sparkSession
    spark.udtf.register("archive_directory", Directory)
    level = archives.select("path").distinct().mapInPandas(_headers, "path string, at long, size long, leaves long, tiles long, inner int, outer int")
    found = []
    for _ in range(MOST_LEVELS):
        rows = spark.sql("select l.path, l.leaves, l.tiles, l.inner, l.outer, d.* from {level} l, lateral archive_directory(l.path, l.at, l.size, l.inner) d", level=level.repartition("path", "at"))
        rows = stored(rows, "directory")
        found.append(rows.where("run > 0").select("path", "tile_id", "run", (F.col("tiles") + F.col("place")).alias("at"), "size", "outer"))
        level = rows.where("run = 0").select("path", (F.col("leaves") + F.col("place")).alias("at"), "size", "leaves", "tiles", "inner", "outer")
        if level.isEmpty():
            out = found[0]
            for f in found[1:]:
                out = out.union(f)
            return out
    raise ValueError(f"leaf directories lie more than {MOST_LEVELS} levels deep")


def in_bounds(zooms: list[int], z: Column, x: Column, y: Column) -> Column:
    """Whether a tile is of one of the zooms and touches the served area."""
    held = F.lit(False)
    for zoom in zooms:
        x0, x1 = geo.tile_x(F.lit(C.AREA_LON[0]), zoom), geo.tile_x(F.lit(C.AREA_LON[1]), zoom)
        y0, y1 = geo.tile_y(F.lit(C.AREA_LAT[1]), zoom), geo.tile_y(F.lit(C.AREA_LAT[0]), zoom)
        held = held | ((z == zoom) & x.between(x0, x1) & y.between(y0, y1))
    return held


def wanted(index: DataFrame, zooms: list[int] | None = None) -> DataFrame:
    """``path, tile_id, z, x, y, at, size, outer`` of each tile, runs spread; with ``zooms`` only those in bounds."""
    each = index.select("path", F.explode(F.sequence(F.col("tile_id"), F.col("tile_id") + F.col("run") - 1)).alias("tile_id"), "at", "size", "outer")
    each = each.withColumn("t", tile_of_id("tile_id")).select("path", "tile_id", "t.z", "t.x", "t.y", "at", "size", "outer")
    return each if zooms is None else each.where(in_bounds(zooms, F.col("z"), F.col("x"), F.col("y")))


_TILE = "tile_id long, z int, x int, y int, content binary"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tiles of ranges in order; a range that several tiles share is read and inflated once."""
    for b in batches:
        out: list[bytes] = []
        k, rows = 0, list(zip(b["path"], b["at"], b["size"], b["outer"], strict=True))
        last, tile = None, b""
        while k < len(rows):
            path, first = rows[k][0], rows[k][1]
            end, j = first, k
            while j < len(rows) and rows[j][0] == path and rows[j][1] <= end + GAP and rows[j][1] + rows[j][2] - first <= max(READ, rows[k][2]):
                end = max(end, rows[j][1] + rows[j][2])
                j += 1
            data = read_range(path, first, end - first)
            for _, at, size, codec in rows[k:j]:
                if (path, at, size) != last:
                    last, tile = (path, at, size), inflate(data[at - first : at - first + size], codec)
                out.append(tile)
            k = j
        yield pd.DataFrame({c: b[c] for c in ("tile_id", "z", "x", "y")} | {"content": out})


def read_tiles(tiles: DataFrame) -> DataFrame:
    """``tile_id, z, x, y, content`` of the rows of ``wanted``, inflated."""
    return tiles.repartitionByRange("path", "at").sortWithinPartitions("path", "at", "tile_id").mapInPandas(_read, _TILE)


FEATURE = "tile_id long, z int, x int, y int, ix int, layer string, geom_type int, extent int, props map<string,string>, parts array<array<struct<x:int,y:int>>>"


def tile_features(tiles: DataFrame) -> DataFrame:
    """The features of each tile of ``read_tiles`` in their order (``ix``), a row each."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FEATURE.split(", ")]
        for b in batches:
            for tile_id, z, x, y, content in zip(b["tile_id"], b["z"], b["x"], b["y"], b["content"], strict=True):
                rows = [{"tile_id": tile_id, "z": z, "x": x, "y": y, "ix": k, **f, "parts": [[{"x": a, "y": o} for a, o in p] for p in f["parts"]]} for k, f in enumerate(features(content))]
                yield pd.DataFrame(rows, columns=names)

    return tiles.mapInPandas(decode, FEATURE)


def archive_features(archives: DataFrame, zooms: list[int] | None = None) -> DataFrame:
    """The features of all tiles of archives (``path``), or of those of some zooms that touch the served area."""
    return tile_features(read_tiles(wanted(entries(archives), zooms)))
