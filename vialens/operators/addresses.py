"""Addresses looked up by key in a table of kept answers, and what is left to ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: an answer counts for a day.
TTL_S = 86_400


def fresh_answers(answers: DataFrame, now: int) -> DataFrame:
    """``key, places`` of the newest answer of each key (``key, at, places``) if it is younger than a day."""
    newest = answers.groupBy("key").agg(F.max_by("places", "at").alias("places"), F.max("at").alias("at"))
    return newest.where(F.lit(now) - F.col("at") < TTL_S).select("key", "places")


def looked_up(requests: DataFrame, answers: DataFrame, now: int) -> DataFrame:
    """``requests`` (with ``key``; null: too short to ask for) with ``places`` and ``asked``: whether the answer has to be fetched.

    A join on the key; requests of one key share an answer, and of those to fetch each key is fetched once."""
    met = requests.join(fresh_answers(answers, now), "key", "left")
    return met.withColumn("asked", F.col("key").isNotNull() & F.col("places").isNull())
