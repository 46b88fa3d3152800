"""Rules that a fix passes before it may touch a vehicle's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vialens.constants import FUTURE_S, TOO_OLD_S
from vialens.functions import codes, geo


def stateless_outcome(not_service: list[str] | None = None) -> Column:
    """The first rule that a fix breaks, of those that need no state; ``pass`` otherwise. The order decides the counters."""
    state = codes.service_state(F.col("service"))
    listed = F.trim(F.coalesce("service", F.lit(""))).isin(not_service or [])
    return (
        F.when(~geo.in_area(F.col("lat"), F.col("lon")), "outside")
        .when(F.col("t") > F.col("seen_at") + FUTURE_S, "future")
        .when((state == "out") | listed, "out_of_service")
        .when(F.col("seen_at") - F.col("t") > TOO_OLD_S, "too_old")
        .otherwise("pass")
    )


def first_reports(fixes: DataFrame, tie: str) -> DataFrame:
    """The first arrival of each report (vehicle, vendor, t): one partial aggregate a key, no window."""
    rest = [c for c in fixes.columns if c not in ("vehicle", "vendor", "t")]
    first = fixes.groupBy("vehicle", "vendor", "t").agg(F.min_by(F.struct(*rest), F.struct("seen_at", tie)).alias("f"))
    return first.select("vehicle", "vendor", "t", "f.*")


def with_previous(fixes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds the time, x and y of the fix before, by ``order`` within ``keys``, as prev_t, prev_x and prev_y."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return fixes.select("*", *(F.lag(c).over(w).alias(f"prev_{c}") for c in ("t", "x", "y")))
