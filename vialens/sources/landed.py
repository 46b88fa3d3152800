"""Landed pages by minute, and reads of all of them or of named minutes only."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialens import constants as C
from vialens.sources.feeds import PAGE, fixes_of_pages

PAGES = "page int, value string, minute string"
#: The folder of pages that were landed as a history; hidden from a reader of the folders by minute.
HISTORY = "_history"


def land(pages: DataFrame, root: str) -> None:
    """Adds pages (``minute, page, value``) to a folder for each minute. Tasks put their files in place themselves: a driver that moves
    them takes longer with every minute."""
    tasks_commit = "mapreduce.fileoutputcommitter.algorithm.version"
    pages.select("page", "value", "minute").repartition("minute").write.mode("append").option(tasks_commit, "2").partitionBy("minute").parquet(root)


def land_history(pages: DataFrame, root: str) -> None:
    """Adds the pages of many minutes at once, dealt by range of ``minute``, as files of neighbouring minutes: a folder for each of some
    hundred thousand minutes takes longer to make than its few pages to write. ``pages_of`` finds both."""
    pages.select("page", "value", "minute").sortWithinPartitions("minute", "page").write.mode("append").parquet(f"{root}/{HISTORY}")


def _name(at: datetime.datetime) -> str:
    return at.strftime("%Y-%m-%dT%H:%M:00Z")


def sampled_hours(now: int, count: int, every_s: int = 3600, lag_s: int = 300) -> list[str]:
    """One minute of each of the last ``count`` hours, the newest five minutes ago."""
    whole = datetime.datetime.fromtimestamp(now - now % 60, datetime.UTC)
    return [_name(whole - datetime.timedelta(seconds=lag_s + every_s * k)) for k in range(count)]


def sampled_nights(now: int, nights: int) -> list[str]:
    """The minutes of the last ``nights`` at which buses sleep; those to come are left out."""
    today = datetime.datetime.fromtimestamp(now, datetime.UTC)
    days = [(today - datetime.timedelta(days=n)).strftime("%Y-%m-%d") for n in range(nights)]
    every = [f"{d}T{t}:00Z" for d in days for t in C.NIGHT_TIMES]
    return [m for m in every if m <= today.strftime("%Y-%m-%dT%H:%M:%SZ")]


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def all_pages(spark: SparkSession, root: str) -> DataFrame:
    """The pages of all minutes, of folders by minute and of histories."""
    pages = spark.read.schema(PAGES).option("basePath", root).parquet(root)
    if _there(spark, f"{root}/{HISTORY}"):
        pages = pages.unionByName(spark.read.schema(PAGES).parquet(f"{root}/{HISTORY}"))
    return pages


def pages_of(spark: SparkSession, root: str, minutes: list[str]) -> DataFrame:
    """The pages of named minutes; folders of other minutes are neither opened nor listed, so that the time doesn't grow with them, and
    of a history only the ranges of rows that may hold one are read, by what its files say of theirs."""
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folders = [f for f in (f"{root}/minute={name(m)}" for m in dict.fromkeys(minutes)) if _there(spark, f)]
    read = spark.read.schema(PAGES)
    pages = read.option("basePath", root).parquet(*folders) if folders else spark.createDataFrame([], PAGES)
    if _there(spark, f"{root}/{HISTORY}"):
        history = spark.read.schema(PAGES).parquet(f"{root}/{HISTORY}")
        pages = pages.union(history) if folders else history
    return pages.where(F.col("minute").isin(minutes))


def read_minutes(spark: SparkSession, root: str, minutes: list[str]) -> tuple[DataFrame, DataFrame]:
    """The fixes of named minutes, and ``minute, failure, n`` of what could not be had: minutes without a page (``missing``)
    and pages that are no JSON of the feed (``damaged``). What can be read counts all the same."""
    pages = pages_of(spark, root, minutes)
    asked = spark.createDataFrame([(m,) for m in minutes], "minute string")
    missing = asked.join(pages.select("minute").distinct(), "minute", "left_anti").select("minute", F.lit("missing").alias("failure"), F.lit(1).cast("long").alias("n"))
    broken = pages.where(F.from_json("value", PAGE)["data"].isNull()).groupBy("minute").agg(F.count("*").alias("n"))
    return fixes_of_pages(pages), missing.union(broken.select("minute", F.lit("damaged").alias("failure"), "n"))
