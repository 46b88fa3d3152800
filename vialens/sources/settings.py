"""Settings files: the table of service aliases and the garages' boxes. A missing file is empty, a damaged one an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialens.functions import codes, geo

ALIASES = "aliases map<string,string>, not_service array<string>"
BOXES = "garages array<struct<buses:int, lat0:double, lon0:double, lat1:double, lon1:double>>"


def _one_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def service_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``alias, target`` rows, and ``code`` rows of what is no service."""
    doc = _one_document(spark, path, ALIASES)
    return doc.select(F.explode("aliases").alias("alias", "target")), doc.select(F.explode("not_service").alias("code")).select(F.trim("code").alias("code"))


def garage_boxes(spark: SparkSession, path: str) -> DataFrame:
    """``x0, y0, x1, y1, buses`` in metres, whichever corners the file gives."""
    g = _one_document(spark, path, BOXES).select(F.explode("garages").alias("g")).select("g.*")
    xa, xb, ya, yb = geo.x_of(F.col("lon0")), geo.x_of(F.col("lon1")), geo.y_of(F.col("lat0")), geo.y_of(F.col("lat1"))
    return g.select(F.least(xa, xb).alias("x0"), F.least(ya, yb).alias("y0"), F.greatest(xa, xb).alias("x1"), F.greatest(ya, yb).alias("y1"), "buses")


def write_garages(boxes: DataFrame, path: str) -> None:
    """Boxes (x0, y0, x1, y1, buses) as one JSON document with corners in degrees, most buses first; a city has some tens."""
    corner = F.struct((-F.col("buses")).alias("o"), F.struct("buses", geo.lat_of(F.col("y0")).alias("lat0"), geo.lon_of(F.col("x0")).alias("lon0"), geo.lat_of(F.col("y1")).alias("lat1"), geo.lon_of(F.col("x1")).alias("lon1")).alias("g"))
    boxes.agg(F.array_sort(F.collect_list(corner)).alias("c")).select(F.col("c.g").alias("garages")).coalesce(1).write.mode("overwrite").json(path)


def judged_aliases(aliases: DataFrame, routes: DataFrame) -> DataFrame:
    """``alias, target, problem, short_name``: what is wrong with an alias, else the name that its route goes by with it.

    A target that no route is called, and an alias that names another route, are problems. A route of provisional name takes
    the first of its sound aliases, in their order, that isn't provisional itself."""
    named = F.broadcast(routes.select(F.col("short_name").alias("target"), "route_ix"))
    own = F.broadcast(routes.select(F.col("short_name").alias("alias"), F.col("route_ix").alias("other")))
    rows = aliases.join(named, "target", "left").join(own, "alias", "left")
    problem = F.when(F.col("route_ix").isNull(), "no such route").when(F.col("other") != F.col("route_ix"), "already another route")
    rows = rows.select("alias", "target", "route_ix", problem.alias("problem"))
    plain = rows.where(F.col("problem").isNull() & codes.is_provisional(F.col("target")) & ~codes.is_provisional(F.col("alias"))).groupBy("target").agg(F.min("alias").alias("renamed"))
    out = rows.join(F.broadcast(plain), "target", "left")
    return out.select("alias", "target", "problem", F.when(F.col("problem").isNull(), F.coalesce("renamed", "target")).alias("short_name"))
