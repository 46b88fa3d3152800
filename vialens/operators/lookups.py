"""Joins with small dimensions: services to routes, dense outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialens.functions import codes


def resolve_service(rows: DataFrame, routes: DataFrame, aliases: DataFrame, code: str = "service") -> DataFrame:
    """Adds ``route_ix`` and ``line``: the route whose name, alias or zero-padded spelling the code is; the first that fits.

    Routes and aliases are dimensions of a few thousand rows and are broadcast. Each spelling is looked up once, in one join:
    the row's spellings are ranked, and the least rank that meets a name wins.
    """
    named = routes.select(F.col("short_name").alias("name"), "route_ix", F.col("short_name").alias("line"))
    named = named.union(aliases.join(routes, F.col("target") == F.col("short_name")).select("alias", "route_ix", "short_name"))
    lookup = F.broadcast(named.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("route_ix", "line")))).alias("__names")))
    found = F.coalesce(*(F.try_element_at("__names", k) for k in codes.code_keys(F.col(code))))
    return rows.join(lookup).withColumn("__hit", found).select(*rows.columns, "__hit.route_ix", "__hit.line")


def dense(keys: DataFrame, grouped: DataFrame, key: str, value: str) -> DataFrame:
    """Every key with its array, empty where nothing was grouped under it."""
    kind = grouped.schema[value].dataType.simpleString()
    return keys.join(grouped, key, "left").select(*keys.columns, F.coalesce(value, F.expr(f"cast(array() as {kind})")).alias(value))
