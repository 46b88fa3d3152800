"""Queries on vehicle states: outcomes, snapshot, arrivals, phases. The matched states have no SQL form; tests hold them against scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialens.operators import processor, views
from vialens.operators.stored import stored
from vialens.plans import fixture
from vialens.plans.registry import query, table


def fleet_network(spark: SparkSession) -> processor.Network:
    return processor.network(fixture.points(spark), fixture.stops(spark), fixture.routes(spark), fixture.aliases(spark), not_service=frozenset(["3"]), garages=[(5850.0, -30.0, 6150.0, 270.0)])


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.repeated_fixes(fixture.fixes(spark, sf_dir)).withColumnRenamed("sentido", "dir")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay's last states, written once: what is published reads them more than once."""
    now = table(spark, sf_dir, "events").agg(F.max(F.expr("1800000000 + 20 * (event_id div 40) + 10"))).first()[0]
    return stored(processor.replay(reports(spark, sf_dir), fleet_network(spark), "states", at_end=now), "states")


def dims(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    shapes = fixture.shapes(spark).select("shape_id", "route_ix", "direction", F.lit(False).alias("circular"), F.concat(F.lit("to "), "direction").alias("headsign"), F.lit(6.0).alias("planned"))
    return shapes, fixture.stops(spark)


@query()
def fix_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fixes met each outcome."""
    return processor.replay(reports(spark, sf_dir), fleet_network(spark), "outcomes").groupBy("outcome").agg(F.count("*").alias("n"))


@query()
def vehicle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir)


@query()
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.snapshot(states(spark, sf_dir), *dims(spark))


@query()
def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.arrivals(states(spark, sf_dir), *dims(spark))


@query()
def phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.phase_counts(states(spark, sf_dir))


@query()
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pending_reasons(states(spark, sf_dir))


@query()
def debug_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few moving vehicles without a direction; the limit is the feature."""
    return views.pending_sample(states(spark, sf_dir), 20)
